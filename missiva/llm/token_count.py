"""Token counts by compiled finite-state transducers.

Two deterministic machines count the tokens of a byte-level vocabulary without building them:

1. A *splitter* over character classes marks where pre-tokens begin. Its transition monoid (all
   maps from states to states that inputs can cause) is compiled once, so that the state map of a
   chunk of text is one small integer, and the maps of a document's chunks compose by a parallel
   prefix scan over a multiplication table. All chunks of a batch advance together.
2. A *counter* over bytes, compiled on demand: each transition carries the signed change of the
   number of emitted tokens. Its state is what the future can depend on: the longest suffix that
   may still grow into a token, and the last tokens (with relative counts) at the borders inside.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from missiva.llm.bpe import MergeForest, forest

CHUNK = 128
#: Pre-tokens whose counts, and counter states, that a worker remembers before it starts anew.
REMEMBERED, STATES = 300_000, 100_000
#: Characters handled together in a worker.
BATCH_CHARS = 2_000_000

# Input symbols of the splitter. LAST: white space before a visible character, MID: other white space.
LETTER, NUMBER, OTHER, SHORT, LONG, SPACE_LAST, WHITE_LAST, MID, PAD = range(9)
# States: start or after a closed pre-token, within a run, after a joining space, n letters of a contraction to go.
CLOSED, IN_LETTERS, IN_NUMBERS, IN_OTHER, IN_WHITE, JOINING, ONE_MORE, TWO_MORE = range(8)


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    codes = np.array([c for c in range(0x110000) if not 0xD800 <= c < 0xE000], dtype=np.uint32)
    every = "".join(map(chr, codes))
    table = np.full(0x110000, OTHER, dtype=np.uint8)
    for pattern, kind in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\p{White_Space}+", MID)):
        for m in regex.finditer(pattern, every):
            table[codes[m.start() : m.end()]] = kind
    return table


def _step(state: int, symbol: int) -> tuple[int, bool]:
    """Next state, and whether a pre-token begins before the symbol."""
    if symbol == PAD:
        return state, False
    if symbol == LETTER:
        if state in (ONE_MORE, TWO_MORE):
            return (CLOSED if state == ONE_MORE else ONE_MORE), False
        return IN_LETTERS, state not in (IN_LETTERS, JOINING)
    if symbol == NUMBER:
        return IN_NUMBERS, state not in (IN_NUMBERS, JOINING)
    if symbol in (SHORT, LONG) and state not in (IN_OTHER, JOINING):
        return (ONE_MORE if symbol == SHORT else TWO_MORE), True
    if symbol in (OTHER, SHORT, LONG):
        return IN_OTHER, state not in (IN_OTHER, JOINING)
    if symbol == SPACE_LAST:
        return JOINING, True
    if symbol == WHITE_LAST:
        return CLOSED, True
    return IN_WHITE, state != IN_WHITE


class Splitter:
    """Transition monoid of the splitter, and chunk-wise parallel runs of it."""

    def __init__(self):
        n = 8
        moves = [tuple(_step(q, s)[0] for q in range(n)) for s in range(9)]
        self.begins = np.array([[_step(q, s)[1] for s in range(9)] for q in range(n)])
        found, todo = {tuple(range(n)): 0}, [tuple(range(n))]
        for f in todo:
            for m in moves:
                g = tuple(m[q] for q in f)
                if g not in found:
                    found[g] = len(found)
                    todo.append(g)
        maps = list(found)
        self.after = np.array([[found[tuple(m[q] for q in f)] for f in maps] for m in moves], dtype=np.int16)
        self.product = np.array([[found[tuple(g[q] for q in f)] for g in maps] for f in maps], dtype=np.int16)
        self.acts = np.array(maps, dtype=np.int8)

    def starts(self, codes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Positions where pre-tokens begin in the concatenation of texts of these lengths."""
        kind = _classes()[codes]
        n = len(codes)
        ends = np.cumsum(lengths)
        last = np.zeros(n, dtype=bool)
        last[ends[lengths > 0] - 1] = True
        white = kind == MID
        visible_next = np.zeros(n, dtype=bool)
        visible_next[:-1] = ~white[1:]
        visible_next &= ~last
        symbol = kind.copy()
        symbol[white & visible_next] = WHITE_LAST
        symbol[white & visible_next & (codes == 32)] = SPACE_LAST
        quote = np.flatnonzero((codes == 39) & ~last)
        if len(quote):
            one = codes[quote + 1]
            symbol[quote[np.isin(one, [ord(c) for c in "stmd"])]] = SHORT
            two = codes[np.minimum(quote + 2, n - 1)]
            pair = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
            symbol[quote[pair & ~last[quote + 1]]] = LONG
        chunks = -(-lengths // CHUNK)
        first = np.cumsum(chunks) - chunks
        place = np.arange(n) + np.repeat(first * CHUNK - (ends - lengths), lengths)
        padded = np.full(int(chunks.sum()) * CHUNK, PAD, dtype=np.uint8)
        padded[place] = symbol
        steps = np.ascontiguousarray(padded.reshape(-1, CHUNK).T)
        width = steps.shape[1]
        # the state map of each chunk's prefixes
        table, size = self.after.ravel(), self.after.shape[1]
        seen = np.empty((CHUNK, width), dtype=np.int16)
        now = np.zeros(width, dtype=np.int16)
        for t in range(CHUNK):
            seen[t] = now
            now = table[steps[t].astype(np.int32) * size + now]
        # inclusive prefix scan of the chunk maps within each text
        rank = np.arange(width) - np.repeat(first, chunks)
        shift = 1
        while shift <= rank.max(initial=0):
            late = np.flatnonzero(rank >= shift)
            joined = self.product[now[late - shift], now[late]]
            now = now.copy()
            now[late] = joined
            shift *= 2
        entry = np.full(width, CLOSED, dtype=np.int8)
        later = np.flatnonzero(rank > 0)
        entry[later] = self.acts[now[later - 1], CLOSED]
        state = self.acts.ravel()[seen.astype(np.int32) * 8 + entry]
        begins = self.begins.ravel()[state.astype(np.int16) * 9 + steps]
        return np.flatnonzero(np.ascontiguousarray(begins.T).ravel()[place])


class Counter:
    """Lazily determinised transducer from bytes to token counts."""

    def __init__(self, vocabulary: MergeForest):
        self.vocabulary = vocabulary
        self.tokens = {s.encode("latin-1"): i for i, s in vocabulary.spelled.items()}
        self.grows = {t[:n] for t in self.tokens for n in range(len(t) + 1)}
        # a state: (suffix, ((last token, count relative to now) at each border within the suffix))
        self.states: list[tuple[bytes, tuple]] = []
        self.number: dict[tuple, int] = {}
        self.moves: dict[int, tuple[int, int]] = {}
        self.start = self._state((b"", ((None, 0),)))

    def _state(self, key: tuple) -> int:
        if key not in self.number:
            self.number[key] = len(self.states)
            self.states.append(key)
        return self.number[key]

    def _move(self, state: int, byte: int) -> tuple[int, int]:
        suffix, borders = self.states[state]
        grown = suffix + bytes([byte])
        for i in range(len(suffix) + 1):
            token = self.tokens.get(grown[i:])
            before, count = borders[i] if token is not None else (None, 0)
            if token is not None and (before is None or self.vocabulary.compatible(before, token)):
                change = count + 1
                break
        else:
            raise ValueError("a byte has no token of its own")
        kept = next(i for i in range(len(grown) + 1) if grown[i:] in self.grows)
        borders = tuple((t, c - change) for t, c in borders[kept:]) + ((token, 0),)
        move = self._state((grown[kept:], borders)), change
        self.moves[state << 8 | byte] = move
        return move

    def count(self, piece: bytes) -> int:
        if len(self.states) > STATES:
            self.states.clear(), self.number.clear(), self.moves.clear()
            self.start = self._state((b"", ((None, 0),)))
        state, total, moves = self.start, 0, self.moves
        for byte in piece:
            state, change = moves.get(state << 8 | byte) or self._move(state, byte)
            total += change
        return total


class _Counts(dict):
    def __init__(self, counter: Counter):
        self.counter = counter

    def __missing__(self, piece: str) -> int:
        if len(self) > REMEMBERED:
            self.clear()
        n = self[piece] = self.counter.count(piece.encode("utf-8"))
        return n


class TokenCounter:
    """Counts for lists of texts with one vocabulary; special strings count one token each."""

    def __init__(self, path: str):
        vocabulary = forest(path)
        self.counts = _Counts(Counter(vocabulary))
        self.splitter = Splitter()
        self.special = regex.compile("|".join(map(regex.escape, vocabulary.specials))) if vocabulary.specials else None

    def __call__(self, texts: list[str]) -> np.ndarray:
        total = np.zeros(len(texts), dtype=np.int64)
        parts, owner = [], []
        for i, text in enumerate(texts):
            pieces = self.special.split(text) if self.special else [text]
            total[i] += len(pieces) - 1
            for p in pieces:
                if p:
                    parts.append(p)
                    owner.append(i)
        if parts:
            whole = "".join(parts)
            lengths = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
            codes = np.frombuffer(whole.encode("utf-32-le"), dtype="<u4")
            at = self.splitter.starts(codes, lengths)
            cuts = at.tolist()
            cuts.append(len(whole))
            known = self.counts
            n = np.fromiter((known[whole[a:b]] for a, b in zip(cuts, cuts[1:])), dtype=np.int64, count=len(at))
            begin = np.searchsorted(at, np.cumsum(lengths) - lengths)
            np.add.at(total, owner, np.add.reduceat(n, begin))
        return total


@lru_cache(maxsize=2)
def _counter(path: str) -> TokenCounter:
    return TokenCounter(path)


def slices(texts: list[str], limit: int) -> Iterator[slice]:
    """Runs of texts of about ``limit`` characters together (a longer text stands alone)."""
    begin, size = 0, 0
    for i, text in enumerate(texts):
        if size and size + len(text) > limit:
            yield slice(begin, i)
            begin, size = i, 0
        size += len(text)
    if begin < len(texts):
        yield slice(begin, len(texts))


def count_tokens(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every row.

    One row per input row, repeated rows included; a null text counts as empty (0 bytes, 0 tokens),
    a null id stays null, other columns are ignored. Texts of any length are handled whole. An
    empty table gives an empty result. No shuffle.
    """

    def run(batches):
        counter = _counter(path)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            n = np.concatenate([counter(texts[s]) for s in slices(texts, BATCH_CHARS)] or [np.zeros(0, dtype=np.int64)])
            size = [len(t.encode("utf-8")) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array(n > limit, pa.bool_())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
