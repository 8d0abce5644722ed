"""Periodic runs of words by a suffix automaton with link-cut access.

The prefixes of a text walk up the suffix links of its automaton in turn. Every path of links is kept
cut into segments of states whose strings were last seen at the same end; a new end recolours its
whole path (the access of a link-cut forest). A segment that ends at state ``v`` and was last seen
``d`` words before is a square if ``d`` is at most the length of ``v``, and the square reaches back
as far as the text keeps the period ``d``; where the next word breaks the period, it is a whole run.

Only words inside repeated windows can lie in a run. These islands, found with rolling hashes over
all texts of a slice, are what the automata are built for; other words cost no more than a hash.
"""

from __future__ import annotations

import hashlib
import zlib
from array import array
from fractions import Fraction
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from missiva.llm.token_count import slices
from missiva.session import small_batches

#: A run has at least so many words, and so many times its period.
LEAST_LENGTH, LEAST_TIMES = 24, 3
BATCH_CHARS = 1_000_000


class Automaton:
    """Suffix automaton of a sequence of integers, and the link-cut forest over its suffix links.

    Most states have one transition, which two arrays hold; only states with more have a dictionary.
    """

    def __init__(self, words: list[int]):
        self.length, self.link = array("i", [0]), array("i", [-1])
        self.by, self.to = array("i", [-1]), array("i", [-1])
        self.more: dict[int, dict[int, int]] = {}
        self.prefix = array("i", [0])  # state of each prefix
        last = 0
        for word in words:
            last = self._append(last, word)
            self.prefix.append(last)
        n = len(self.link)
        # splay trees over path segments, by depth; a tree's root keeps its colour and its path parent
        self.left, self.right, self.up = array("i", [-1]) * n, array("i", [-1]) * n, array("i", self.link)
        self.colour = array("i", [0]) * n

    def _new(self, length: int, link: int) -> int:
        self.length.append(length)
        self.link.append(link)
        self.by.append(-1)
        self.to.append(-1)
        return len(self.link) - 1

    def _next(self, state: int, word: int) -> int:
        if self.by[state] == word:
            return self.to[state]
        more = self.more.get(state)
        return more.get(word, -1) if more else -1

    def _set(self, state: int, word: int, to: int) -> None:
        if self.by[state] in (word, -1):
            self.by[state], self.to[state] = word, to
        else:
            self.more.setdefault(state, {})[word] = to

    def _append(self, last: int, word: int) -> int:
        new = self._new(self.length[last] + 1, 0)
        p = last
        while p >= 0 and (q := self._next(p, word)) < 0:
            self._set(p, word, new)
            p = self.link[p]
        if p < 0:
            return new
        if self.length[q] == self.length[p] + 1:
            self.link[new] = q
            return new
        copy = self._new(self.length[p] + 1, self.link[q])
        self.by[copy], self.to[copy] = self.by[q], self.to[q]
        if q in self.more:
            self.more[copy] = dict(self.more[q])
        while p >= 0 and self._next(p, word) == q:
            self._set(p, word, copy)
            p = self.link[p]
        self.link[q] = self.link[new] = copy
        return new

    def _rotate(self, x: int) -> None:
        left, right, up = self.left, self.right, self.up
        y = up[x]
        z = up[y]
        if left[y] == x:
            inner = left[y] = right[x]
            right[x] = y
        else:
            inner = right[y] = left[x]
            left[x] = y
        if inner >= 0:
            up[inner] = y
        if z >= 0:
            if left[z] == y:
                left[z] = x
            elif right[z] == y:
                right[z] = x
        up[y], up[x] = x, z

    def _splay(self, x: int) -> None:
        """Bring ``x`` to the root of its segment's tree; the colour stays with the root."""
        left, right, up = self.left, self.right, self.up
        top = x
        while (y := up[top]) >= 0 and (left[y] == top or right[y] == top):
            top = y
        if top == x:
            return
        colour = self.colour[top]
        while (y := up[x]) >= 0 and (left[y] == x or right[y] == x):
            z = up[y]
            if z >= 0 and (left[z] == y or right[z] == y):
                self._rotate(y if (left[z] == y) == (left[y] == x) else x)
            self._rotate(x)
        self.colour[x] = colour

    def access(self, state: int, end: int) -> list[tuple[int, int]]:
        """Recolour the path from ``state`` to the root to ``end``; the segments it crossed: (longest length, last end)."""
        crossed = []
        below, x = -1, state
        while x >= 0:
            self._splay(x)
            if self.colour[x]:
                crossed.append((self.length[x], self.colour[x]))
            cut = self.right[x]
            if cut >= 0:
                self.colour[cut] = self.colour[x]  # the part below keeps its own last end
            self.right[x] = below
            below, x = x, self.up[x]
        self.colour[below] = end
        return crossed


def runs_of(words: list[int], least_length: int = LEAST_LENGTH, least_times: int = LEAST_TIMES) -> list[tuple[int, int, int]]:
    """``(start, length, period)`` of all runs of a sequence of integers, by start, then period.

    A run is a stretch of smallest period p with at least ``least_length`` words and ``least_times``
    (2 or more) times p that no neighbour extends.
    """
    automaton = Automaton(words)
    found, n = [], len(words)
    for end in range(1, n + 1):
        for reach, before in automaton.access(automaton.prefix[end], end):
            period = end - before
            length = reach + period
            if length >= least_length and length >= least_times * period and (end == n or words[end] != words[end - period]):
                found.append((end - length, length, period))
    return sorted(found, key=lambda r: (r[0], r[2]))


def islands(words: np.ndarray, lengths: np.ndarray, window: int) -> list[tuple[int, int]]:
    """Maximal stretches of words that lie in ``window`` words found twice or more in their text.

    Windows count as equal by a 64-bit rolling hash: that never misses a repeat, and one too many only
    makes an island that holds no run.
    """
    n = len(words)
    if n < window:
        return []
    owner = np.repeat(np.arange(len(lengths)), lengths)
    key = np.zeros(n - window + 1, dtype=np.uint64)
    mixed = (words.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    for k in range(window):
        key = key * np.uint64(0xD1342543DE82EF95) + mixed[k : k + len(key)]
    inside = owner[: len(key)] == owner[window - 1 :]
    at = np.flatnonzero(inside)
    order = np.lexsort((key[at], owner[at]))
    at = at[order]
    same = (key[at[1:]] == key[at[:-1]]) & (owner[at[1:]] == owner[at[:-1]])
    twice = np.zeros(len(at), dtype=bool)
    twice[1:] |= same
    twice[:-1] |= same
    edge = np.zeros(n + 1, dtype=np.int64)
    np.add.at(edge, at[twice], 1)
    np.add.at(edge, at[twice] + window, -1)
    covered = np.cumsum(edge[:-1]) > 0
    starts = np.zeros(n, dtype=bool)
    begins = np.cumsum(lengths) - lengths
    starts[begins[lengths > 0]] = True
    begin = covered & (starts | ~np.concatenate([[False], covered[:-1]]))
    last = covered & np.concatenate([starts[1:] | ~covered[1:], [True]])
    return list(zip(np.flatnonzero(begin).tolist(), (np.flatnonzero(last) + 1).tolist()))


def planted(doc_id: int | None, words: list) -> list:
    """The words of a document with its planted period, if its id asks for one."""
    n = len(words)
    if doc_id is None or not n:
        return words
    h = zlib.crc32(b"%d" % doc_id)
    if h % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * (-(-(n - a) // p)))[: n - a]


def find_runs(texts: list[list[bytes]], least_length: int = LEAST_LENGTH, least_times: int = LEAST_TIMES) -> list[list[tuple[int, int, int]]]:
    """Runs of each list of words."""
    lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    numbers, fresh = {}, count()
    words = np.fromiter((numbers.setdefault(w, i) for ws in texts for w, i in zip(ws, fresh)), dtype=np.int64, count=int(lengths.sum()))
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    ends = np.cumsum(lengths)
    # every window of a third of the shortest run comes again one period away, within the run
    for a, b in islands(words, lengths, least_length // 3):
        if b - a >= least_length:
            text = int(np.searchsorted(ends, a, side="right"))
            begin = a - int(ends[text] - lengths[text])
            found[text] += [(begin + s, n, p) for s, n, p in runs_of(words[a:b].tolist(), least_length, least_times)]
    return found


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words without those that a run contains after its first period, one space between."""
    kept, at = [], 0
    for a, b in sorted((s + p, s + n) for s, n, p in runs):
        if a > at:
            kept.extend(words[at:a])
        at = max(at, b)
    kept.extend(words[at:])
    return b" ".join(kept)


#: Columns of the result; those after the digests can be left out.
COLUMNS = {
    "doc_id": pa.int64(), "n_runs": pa.int64(), "start": pa.int64(), "length": pa.int64(), "period": pa.int64(), "exponent_milli": pa.int64(), "runs_sha256": pa.string(), "collapsed_sha256": pa.string(),
    "runs": pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])), "collapsed": pa.string(),
}
SCHEMA = {"runs": "array<struct<start: long, length: long, period: long>>", "runs_sha256": "string", "collapsed_sha256": "string", "collapsed": "string"}


def periodic_runs(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least_length: int = LEAST_LENGTH, plant: bool = False, keep: tuple[str, ...] = ("runs", "collapsed")) -> DataFrame:
    """All periodic runs of the words of every row, and the text without their repetitions.

    Runs have three periods and ``least_length`` words or more. ``start, length, period,
    exponent_milli`` are those of the run with the greatest length per period (of equals the smallest
    start, then period), nulls without a run; the digests are of all runs and of the collapsed text.
    ``plant`` first writes the periods into the words that ids ask for (a null id asks for none).
    One row per input row, repeated rows included; a null or empty text has no words, no runs and an
    empty collapsed text; a null id stays null; other columns are ignored. Texts of any length are
    handled whole. An empty table gives an empty result. No shuffle.
    """
    small_batches(docs.sparkSession)
    columns = {c: t for c, t in COLUMNS.items() if c in keep or c not in ("runs", "collapsed")}

    def row(doc_id, words: list[bytes], runs: list[tuple[int, int, int]]) -> dict:
        start, length, period = min(runs, key=lambda r: (Fraction(-r[1], r[2]), r[0], r[2])) if runs else (None, None, None)
        text = collapsed(words, runs)
        out = {"doc_id": doc_id, "n_runs": len(runs), "start": start, "length": length, "period": period, "exponent_milli": 1000 * length // period if runs else None}
        out["runs_sha256"] = hashlib.sha256(b"".join(b"%d,%d,%d\n" % r for r in runs)).hexdigest()
        out["collapsed_sha256"] = hashlib.sha256(text).hexdigest()
        return out | {"runs": [dict(zip(("start", "length", "period"), r)) for r in runs] if "runs" in keep else None, "collapsed": text.decode("utf-8") if "collapsed" in keep else None}

    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_pylist()
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for s in slices(texts, BATCH_CHARS):
                words = [t.encode("utf-8").split() for t in texts[s]]
                if plant:
                    words = [planted(i, w) for i, w in zip(ids[s], words)]
                rows = [row(*x) for x in zip(ids[s], words, find_runs(words, least_length))]
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in columns.items()], names=list(columns))

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, ", ".join(f"{c} {SCHEMA.get(c, 'long')}" for c in columns))
