"""Byte-pair vocabularies: merge forest and exact pair compatibility.

A vocabulary is a forest of merges: token ``t`` is the union of two parts made at merge rank
``r(t)``; base symbols have rank -1. For two adjacent tokens ``u v`` the pair is *compatible* when
byte-pair encoding of their joined symbols gives exactly ``[u, v]``. A sequence of tokens is the
encoding of its symbols if and only if every adjacent pair is compatible, which is what both the
backtracking encoder and the counting transducer rely on.
"""

from __future__ import annotations

import json
from functools import lru_cache

#: Marks the last symbol of a word in vocabularies with an end-of-word suffix.
END = 256


def byte_symbols() -> dict[str, int]:
    """Printable stand-in of each byte: itself if printable, else the next free code from 256."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class MergeForest:
    """Vocabulary of a tokenizers JSON file.

    Tokens are spelled as strings of symbols: ``chr(byte)``, or ``chr(byte + END)`` for the last
    byte of a word where the file declares an end-of-word suffix.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"] if t.get("special")}
        self.names = {i: t for t, i in model["vocab"].items()} | {i: t for t, i in self.specials.items()}
        as_byte = byte_symbols()
        cut = len(self.suffix)

        def spell(token: str) -> str:
            if cut and token.endswith(self.suffix):
                body = [as_byte[c] for c in token[:-cut]]
                body[-1] += END
            else:
                body = [as_byte[c] for c in token]
            return "".join(map(chr, body))

        self.spelled = {i: spell(t) for t, i in model["vocab"].items()}
        self.id_of = {s: i for i, s in self.spelled.items()}
        self.rank_of_pair: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}
        for rank, merge in enumerate(model["merges"]):
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            a, b = model["vocab"][left], model["vocab"][right]
            made = self.id_of[self.spelled[a] + self.spelled[b]]
            self.rank_of_pair[a, b] = rank
            self.parts.setdefault(made, (a, b, rank))
        self._edge: dict[tuple[int, int], list[tuple[int, float]]] = {}
        self._fits: dict[int, bool] = {}

    def edge(self, token: int, side: int) -> list[tuple[int, float]]:
        """Tokens that stand at one edge of ``token`` while it is built, each with the rank at
        which it is used up. ``side`` 1 is the right edge, 0 the left edge."""
        known = self._edge.get((token, side))
        if known is None:
            known, t, until = [(token, float("inf"))], token, float("inf")
            while t in self.parts:
                until = self.parts[t][2]
                t = self.parts[t][side]
                known.append((t, until))
            self._edge[token, side] = known
        return known

    def compatible(self, u: int, v: int) -> bool:
        """Does byte-pair encoding leave the border between ``u`` and ``v`` standing?

        A merge across the border happens when both of its parts are there and its rank comes
        before the merge that uses up the left part, and not after the one that uses up the right
        part (of equal ranks the left-most merges first).
        """
        key = u << 20 | v
        fits = self._fits.get(key)
        if fits is None:
            ranks, fits = self.rank_of_pair, True
            for a, until_a in self.edge(u, 1):
                for b, until_b in self.edge(v, 0):
                    rank = ranks.get((a, b))
                    if rank is not None and rank < until_a and rank <= until_b:
                        fits = False
                        break
                if not fits:
                    break
            if len(self._fits) > 1_000_000:
                self._fits.clear()
            self._fits[key] = fits
        return fits

    def forget(self) -> None:
        """What was worked out of pairs and edges."""
        self._fits.clear()
        self._edge.clear()


@lru_cache(maxsize=4)
def forest(path: str) -> MergeForest:
    """One vocabulary per worker process."""
    return MergeForest(path)
