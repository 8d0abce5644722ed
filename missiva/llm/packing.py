"""Order-preserving packing of token streams into windows of bounded size.

The documents of a partition are one stream of tokens in the order of their rows. A dynamic program
chooses the cuts of the stream: a window pays its padding, a cut inside a document pays a penalty,
a smaller one behind a sentence than elsewhere. The cheapest predecessor of a cut comes from a
monotone queue over the last ``size`` tokens, so that the work is linear in the possible cuts;
windows of a power of two tokens need no padding and are tried beside it.
"""

from __future__ import annotations

import json
import zlib
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from missiva.llm.bpe import forest
from missiva.session import small_batches

#: Penalties, in tokens of padding, of a cut behind a sentence and of a cut within one.
AFTER_SENTENCE, WITHIN_SENTENCE = 4, 32
#: Of the sentence ends within so many tokens one is a possible cut; longer sentences get inner cuts.
GRAIN, LONG_SENTENCE, INNER = 8, 128, 64
#: Tokens that are cut together, and windows at their end that are cut anew with what follows.
STRETCH, UNSETTLED = 1_000_000, 4

#: Fixed value: the pre-token pattern of the byte-level vocabulary.
PRE_TOKENS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Tokens:
    """Ids of texts as the vocabulary's own library gives them, and where sentences end among them."""

    def __init__(self, path: str):
        vocabulary = forest(path)
        spelled = {i: s.encode("latin-1") for i, s in vocabulary.spelled.items() if i not in vocabulary.specials.values()}
        ranks = [vocabulary.parts[i][2] for i in sorted(vocabulary.parts)]
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        kind = (spec.get("pre_tokenizer") or {}).get("type")
        if vocabulary.suffix or kind != "ByteLevel" or ranks != sorted(ranks) or spec.get("normalizer"):
            raise ValueError("not a byte-level vocabulary whose ids are in the order of its merges")
        self.encoding = tiktoken.Encoding("packing", pat_str=PRE_TOKENS, mergeable_ranks={s: i for i, s in spelled.items()}, special_tokens=vocabulary.specials)
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        top = max([*spelled, *vocabulary.specials.values()]) + 1
        self.ends_line, self.ends_sentence, self.opens = (np.zeros(top, dtype=bool) for _ in range(3))
        for i, s in spelled.items():
            self.ends_line[i] = s.endswith(b"\n")
            self.ends_sentence[i] = s.rstrip(b"\"')]").endswith((b".", b"!", b"?"))
            self.opens[i] = s[:1].isspace()

    def ids(self, text: str) -> np.ndarray:
        try:
            return self.encoding.encode_to_numpy(text, allowed_special="all")
        except ValueError:  # its splitter gives up on very long white space
            return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    def sentence_ends(self, ids: np.ndarray) -> np.ndarray:
        """Numbers of tokens before each sentence end inside ``ids``."""
        return np.flatnonzero(self.ends_line[ids[:-1]] | (self.ends_sentence[ids[:-1]] & self.opens[ids[1:]])) + 1


@lru_cache(maxsize=2)
def _tokens(path: str) -> Tokens:
    return Tokens(path)


def possible_cuts(n: int, ends: np.ndarray, sentences: np.ndarray, last: bool, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Ascending positions from 0 to ``n`` where a stream may be cut, none over ``size`` apart, and their penalties.

    ``ends``: positions behind documents; ``sentences``: positions behind sentences. The end of the
    last stretch of a stream may be cut anywhere, as its last window would else be padded by half.
    """
    firm = np.union1d(ends, [0, n])
    if len(sentences):
        sentences = sentences[np.flatnonzero(np.diff(sentences // GRAIN, prepend=-1))]
    known = np.union1d(firm, sentences)
    gaps = np.flatnonzero(np.diff(known) > min(LONG_SENTENCE, size))
    step = min(INNER, size)
    inner = [np.arange(known[g] + step, known[g + 1], step) for g in gaps]
    if last:
        inner.append(np.arange(max(0, n - size), n))
    at = np.union1d(known, np.concatenate(inner)) if inner else known
    penalty = np.full(len(at), WITHIN_SENTENCE, dtype=np.int64)
    penalty[np.searchsorted(at, sentences)] = AFTER_SENTENCE
    penalty[np.searchsorted(at, firm)] = 0
    return at.astype(np.int64), penalty


def best_cuts(at: np.ndarray, penalty: np.ndarray, size: int) -> np.ndarray:
    """The cheapest choice of the positions ``at``, first and last included, none over ``size`` apart.

    A window costs its padding up to ``size``, none at a power of two, and the penalty of its end.
    Of equal choices the one with the earliest predecessor counts, so that windows are long.
    """
    n = len(at)
    free: dict[int, list[int]] = {}
    power = 1
    while power < size:
        j = np.searchsorted(at, at - power)
        for i in np.flatnonzero((at >= power) & (at[np.minimum(j, n - 1)] == at - power)).tolist():
            free.setdefault(i, []).append(int(j[i]))
        power *= 2
    places, extra = at.tolist(), penalty.tolist()
    best, back = [0] * n, [0] * n
    queue: deque[tuple[int, int]] = deque()
    for i in range(1, n):
        here = places[i]
        value = best[i - 1] + places[i - 1]
        while queue and queue[-1][0] > value:
            queue.pop()
        queue.append((value, i - 1))
        while places[queue[0][1]] < here - size:
            queue.popleft()
        value, j = queue[0]
        cost = value + size - here
        for k in free.get(i, ()):
            if best[k] < cost:
                cost, j = best[k], k
        best[i], back[i] = cost + extra[i], j
    chosen = [n - 1]
    while chosen[-1]:
        chosen.append(back[chosen[-1]])
    return at[chosen[::-1]]


class Packer:
    """Windows of one stream, cut stretch by stretch."""

    def __init__(self, tokens: Tokens, size: int, end_id: int, first_sequence: int):
        self.tokens, self.size, self.sequence = tokens, size, first_sequence
        self.end = np.array([end_id], dtype=np.uint32)
        # rows that are not yet cut: id, its tokens in all, tokens of it that are cut already, the others
        self.rows: list[tuple[int | None, int, int, np.ndarray]] = []
        self.waiting = 0

    def add(self, doc_id: int | None, text: str) -> Iterator[pa.RecordBatch]:
        ids = np.concatenate([self.tokens.ids(text), self.end])
        self.rows.append((doc_id, len(ids), 0, ids))
        self.waiting += len(ids)
        if self.waiting >= STRETCH:
            yield from self.cut(last=False)

    def cut(self, last: bool) -> Iterator[pa.RecordBatch]:
        if not self.rows:
            return
        size = self.size
        lengths = np.array([len(r[3]) for r in self.rows])
        ends = np.cumsum(lengths)
        begins = ends - lengths
        ids = np.concatenate([r[3] for r in self.rows]).astype("<u4")
        cuts = best_cuts(*possible_cuts(len(ids), ends, self.tokens.sentence_ends(ids), last, size), size)
        if not last:
            cuts = cuts[: max(2, len(cuts) - UNSETTLED)]
        done = int(cuts[-1])
        borders = np.union1d(cuts, np.minimum(begins, done))
        a, b = borders[:-1], borders[1:]
        row = np.searchsorted(begins, a, side="right") - 1
        window = np.searchsorted(cuts, a, side="right") - 1
        cut_before = np.array([r[2] for r in self.rows])
        raw = memoryview(ids.tobytes())
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([self.rows[r][0] for r in row.tolist()], pa.int64()),
                pa.array(a - begins[row] + cut_before[row], pa.int64()),
                pa.array(b - a, pa.int64()),
                pa.array([zlib.crc32(raw[4 * x : 4 * y]) for x, y in zip(a.tolist(), b.tolist())], pa.int64()),
                pa.array([self.rows[r][1] for r in row.tolist()], pa.int64()),
                pa.array(self.sequence + window, pa.int64()),
                pa.array(a - cuts[window], pa.int64()),
                pa.array([raw[4 * x : 4 * y].tobytes() for x, y in zip(a.tolist(), b.tolist())], pa.binary()),
            ],
            names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"],
        )
        self.sequence += len(cuts) - 1
        rest = int(np.searchsorted(ends, done, side="right"))
        self.rows = [(d, n, c + max(0, done - int(s)), x[max(0, done - int(s)) :]) for (d, n, c, x), s in zip(self.rows[rest:], begins[rest:])]
        self.waiting = len(ids) - done


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"


def pack(docs: DataFrame, path: str, *, size: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True) -> DataFrame:
    """Pieces of all texts in windows of at most ``size`` tokens, one row per piece.

    A document's tokens are its text's ids in the byte-level vocabulary at ``path`` and ``end_id``.
    ``ids`` are a piece's tokens as little-endian unsigned 32-bit integers; a window is a
    ``sequence_id``, within which the pieces stand without gaps from ``offset`` 0. Each token lies
    in exactly one piece.

    Every partition of ``docs`` is a stream of its own in the order of its rows, so that nothing is
    shuffled and only its last window is padded for want of text; ``docs`` should be a table, whose
    partitions come out alike when a task runs again. A null text counts as empty (one token), a null
    id stays null, rows that share an id are packed each, other columns are ignored. Texts of any
    length are handled whole, runs without a sentence end are cut within. An empty table gives an
    empty result.
    """
    small_batches(docs.sparkSession)

    def run(batches):
        packer = Packer(_tokens(path), size, end_id, TaskContext.get().partitionId() << 36)
        for batch in batches:
            for s in range(batch.num_rows):
                yield from packer.add(batch.column(0)[s].as_py(), batch.column(1)[s].as_py() or "")
        yield from packer.cut(last=True)

    def thin(batches):
        for batch in run(batches):
            yield batch.drop_columns(["ids"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run if keep_ids else thin, SCHEMA if keep_ids else SCHEMA.removesuffix(", ids binary"))
