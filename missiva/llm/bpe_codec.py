"""Exact byte-pair encoding by backtracking, and decoding by an offset table.

Encoding a word: an Aho-Corasick automaton over the reversed tokens gives, in one pass, the tokens
that begin at each symbol, longest first. The encoder takes the longest token that is compatible
with the one before; where none is left it steps back and marks the border as dead. Since a valid
sequence of tokens up to a border is unique, each border is left at most once, so time is linear
in the matches. Decoding gathers token names from one byte array by offsets.
"""

from __future__ import annotations

import hashlib
import unicodedata

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from missiva.llm.bpe import END, MergeForest
from missiva.llm.token_count import slices
from missiva.session import held, lean

REMEMBERED = 150_000
BATCH_CHARS = 1_000_000

#: The word pattern that the lower-casing vocabulary was made with.
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\p{White_Space}\p{L}\p{N}]+")


class Encoder:
    """Words to token ids."""

    def __init__(self, vocabulary: MergeForest):
        self.vocabulary = vocabulary
        self.automaton = ahocorasick.Automaton()
        for token, spelled in vocabulary.spelled.items():
            self.automaton.add_word(spelled[::-1], (len(spelled), token))
        self.automaton.make_automaton()

    def word(self, piece: bytes) -> list[int]:
        """Token ids of one pre-token; its last byte carries the end-of-word mark if there is one."""
        symbols = piece.decode("latin-1")
        if self.vocabulary.suffix:
            symbols = symbols[:-1] + chr(ord(symbols[-1]) + END)
        n = len(symbols)
        begins: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        for end, match in self.automaton.iter(symbols[::-1]):
            begins[n - 1 - end].append(match)
        for matches in begins:
            matches.sort()  # the longest is taken from the end
        fits, dead = self.vocabulary.compatible, bytearray(n + 1)
        out: list[int] = []
        borders = [0]
        while borders[-1] < n:
            at = borders[-1]
            while begins[at]:
                size, token = begins[at].pop()
                if not dead[at + size] and (not out or fits(out[-1], token)):
                    out.append(token)
                    borders.append(at + size)
                    break
            else:
                if not out:
                    raise ValueError("a byte has no token of its own")
                dead[at] = 1
                borders.pop()
                out.pop()
        return out


class _Ids(dict):
    """Pre-token to its ids as little-endian unsigned 32-bit integers."""

    def __init__(self, encoder: Encoder):
        self.encoder = encoder

    def __missing__(self, piece: str) -> bytes:
        if len(self) > REMEMBERED:
            self.clear()
        ids = self[piece] = np.array(self.encoder.word(piece.encode("utf-8")), dtype="<u4").tobytes()
        return ids


def lowered(text: str) -> str:
    """Canonical composition, then each character's own lower case (no word-final sigma)."""
    text = unicodedata.normalize("NFC", text)
    return text.replace("Σ", "σ").lower() if "Σ" in text else text.lower()


class Codec:
    """Encode texts to id bytes and decode id bytes to UTF-8."""

    def __init__(self, path: str):
        vocabulary = MergeForest(path)
        self.ids = _Ids(Encoder(vocabulary))
        self.specials = {s: np.array([i], dtype="<u4").tobytes() for s, i in vocabulary.specials.items()}
        self.special = regex.compile("(" + "|".join(map(regex.escape, self.specials)) + ")") if self.specials else None
        top = max(vocabulary.names) + 1
        names = [(vocabulary.names.get(i, "") + " ").encode("utf-8") for i in range(top)]
        self.size = np.fromiter(map(len, names), dtype=np.int64, count=top)
        self.offset = np.cumsum(self.size) - self.size
        self.blob = np.frombuffer(b"".join(names), dtype=np.uint8)

    def encode(self, text: str) -> bytes:
        known = self.ids.__getitem__
        if self.special is None or "<" not in text:
            return b"".join(map(known, WORDS.findall(lowered(text))))
        return b"".join(self.specials[p] if p in self.specials else b"".join(map(known, WORDS.findall(lowered(p)))) for p in self.special.split(text))

    def decode(self, parts: list[bytes]) -> list[memoryview]:
        """Token names of each part, joined by one space."""
        ids = np.frombuffer(b"".join(parts), dtype="<u4")
        size = self.size[ids]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        place = np.repeat(self.offset[ids] - (ends - size), size)
        place += np.arange(total)
        joined = memoryview(self.blob[place].tobytes())
        tokens = np.cumsum([len(p) // 4 for p in parts])
        stops = [int(ends[t - 1]) if t else 0 for t in tokens]
        return [joined[a : max(a, b - 1)] for a, b in zip([0, *stops], stops)]


    def forget(self) -> None:
        """Words and pairs seen so far."""
        self.ids.clear()
        self.ids.encoder.vocabulary.forget()


def _codec(path: str) -> Codec:
    """The codec of one vocabulary, kept by a worker over its tasks."""
    return held(("codec", path), lambda: Codec(path))


SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, ids binary, decoded string"


def encode_documents(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ("ids", "decoded")) -> DataFrame:
    """Ids and decoded text of every row, with their digests.

    ``doc_id, n_tokens, ids_sha256, decoded_sha256`` and, as asked for in ``keep``, ``ids`` (little-
    endian unsigned 32-bit integers) and ``decoded`` (token names joined by a space). One row per
    input row, repeated rows included; a null text counts as empty (no ids, empty decoded text), a
    null id stays null, other columns are ignored, and an empty table gives an empty result. Texts
    of any length are handled whole. No shuffle.
    """
    fields = [f for f in SCHEMA.split(", ") if f.split()[0] in ("doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *keep)]
    wanted = [f.split()[0] for f in fields]

    def run(batches):
        codec = _codec(path)
        for batch in batches:
            keys = batch.column(0)
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for s in slices(texts, BATCH_CHARS):
                ids = [codec.encode(t) for t in texts[s]]
                decoded = codec.decode(ids)
                cols = {
                    "doc_id": keys.slice(s.start, s.stop - s.start),
                    "n_tokens": pa.array([len(x) // 4 for x in ids], pa.int64()),
                    "ids_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in ids]),
                    "decoded_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in decoded]),
                }
                if "ids" in keep:
                    cols["ids"] = pa.array(ids, pa.binary())
                if "decoded" in keep:
                    cols["decoded"] = pa.array([bytes(x).decode("utf-8") for x in decoded])
                yield pa.RecordBatch.from_arrays([cols[c] for c in wanted], names=wanted)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(lean(run, lambda: _codec(path).forget()), ", ".join(fields))
