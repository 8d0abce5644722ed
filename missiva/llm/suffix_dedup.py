"""Removal of repeated substrings by distributed prefix doubling over sampled suffixes.

Every 100-byte string that starts earlier elsewhere marks its later occurrences. Ranking all byte
positions would multiply the input many times over, so the doubling runs on a sample of suffixes
that is chosen by content alone: of the 60 positions from the start of a 100-byte string, the one
whose 16 bytes hash lowest. Equal strings choose equal places, so no repeat is lost, and about one
position in thirty is a sample; it stands for the run of string starts that chose it.

Round 1 ranks samples by their first 41 bytes (which every string of the run contains) paired with
the whole stretch of the run, and sorts the rank pairs. A sample of unique rank is finished. A
sample whose stretch equals an earlier one is a repeat throughout. What is left - one sample per
different stretch where a rank is shared - goes to round 2, at the next offset: each start of its run
gets the pair (rank of bytes 0-50, rank of bytes 50-100), and sorting the pairs reaches the
threshold. First ranks are 64-bit fingerprints made inside the tasks; every decision rests on two of
them. Both sorts deal rows by sampled ranges of (rank, rank, position), so a very common string is
spread over tasks; what straddles two tasks is passed on to the exact second round, or settled there
by a table of two rows per task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from missiva.session import lean, materialize

LENGTH, WIDTH, GRAM = 100, 60, 16
CORE = LENGTH - WIDTH + 1
#: Bytes handled together; a longer text is cut into overlapping stretches of string starts.
BLOCK = 500_000
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = 2 * BLOCK + 4 * LENGTH
    up, down = np.full(n, BASE), np.full(n, INVERSE)
    up[0] = down[0] = 1
    return np.random.default_rng(5).integers(0, 1 << 64, 256, dtype=np.uint64), np.cumprod(up), np.cumprod(down)


def _mix(x: np.ndarray) -> np.ndarray:
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return x


class Fingerprints:
    """64-bit fingerprints of substrings of one block, from prefix sums."""

    def __init__(self, block: np.ndarray):
        values, up, self.down = _tables()
        self.sums = np.zeros(len(block) + 1, dtype=np.uint64)
        np.cumsum(values[block] * up[: len(block)], out=self.sums[1:])

    def every(self, size: int) -> np.ndarray:
        """Of all substrings of one size."""
        n = len(self.sums) - size
        return _mix((self.sums[size:] - self.sums[:n]) * self.down[:n])

    def of(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((self.sums[end] - self.sums[begin]) * self.down[begin])


def blocks(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Joined texts of about BLOCK bytes: bytes, and per stretch its text, offset in the text and length."""
    held: list[tuple[int, int, bytes]] = []
    size = 0

    def flush():
        return (
            np.frombuffer(b"".join(x for _, _, x in held), dtype=np.uint8),
            np.array([i for i, _, _ in held], dtype=np.int64),
            np.array([o for _, o, _ in held], dtype=np.int64),
            np.array([len(x) for _, _, x in held], dtype=np.int64),
        )

    for i, text in enumerate(texts):
        for at in range(0, max(1, len(text) - LENGTH + 1), BLOCK):
            piece = text[at : at + BLOCK + LENGTH - 1]
            if len(piece) < LENGTH:
                continue
            if size and size + len(piece) > BLOCK:
                yield flush()
                held, size = [], 0
            held.append((i, at, piece))
            size += len(piece)
    if held:
        yield flush()


def samples(texts: list[bytes]) -> Iterator[tuple[np.ndarray, ...]]:
    """Per sample: core rank, stretch rank, number of the text, first string start, further starts."""
    for block, text, offset, length in blocks(texts):
        prints = Fingerprints(block)
        n = len(block)
        grams = prints.every(GRAM)
        place = np.uint64((1 << 24) - 1)
        least = (grams & ~place) | np.arange(len(grams), dtype=np.uint64)
        span = 1
        while 2 * span <= WIDTH:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        if span < WIDTH:
            least = np.minimum(least[: len(least) - (WIDTH - span)], least[WIDTH - span :])
        ends = np.cumsum(length)
        valid = np.ones(n, dtype=bool)
        for k in range(1, LENGTH):
            valid[ends - k] = False
        starts = np.flatnonzero(valid)
        chosen = (least[starts] & place).astype(np.int64)
        fresh = np.ones(len(starts), dtype=bool)
        fresh[1:] = (chosen[1:] != chosen[:-1]) | (starts[1:] != starts[:-1] + 1)
        first = np.flatnonzero(fresh)
        last = np.append(first[1:], len(starts)) - 1
        low, high, at = starts[first], starts[last], chosen[first]
        core = prints.of(at, at + CORE)
        stretch = _mix(prints.of(low, high + LENGTH) + (high - low).astype(np.uint64))
        owner = np.searchsorted(ends, low, side="right")
        yield core.view(np.int64), stretch.view(np.int64), text[owner], low - (ends - length)[owner] + offset[owner], high - low


def _groups(batches, names: list[str]) -> Iterator[tuple[dict[str, np.ndarray], bool, bool]]:
    """Sorted rows in runs that do not cut a value of the first column; is it the first run, is it the last."""
    held: list[dict[str, np.ndarray]] = []
    first = True
    join = lambda parts: {n: np.concatenate([p[n] for p in parts]) for n in names}
    for batch in batches:
        if batch.num_rows == 0:
            continue
        cols = {n: batch.column(n).to_numpy(zero_copy_only=False) for n in names}
        lead = cols[names[0]]
        if held and lead[-1] == held[-1][names[0]][-1]:
            held.append(cols)
            continue
        held.append(cols)
        cut = int(np.searchsorted(lead, lead[-1], side="left"))
        rest = {n: v[cut:] for n, v in cols.items()}
        held[-1] = {n: v[:cut] for n, v in cols.items()}
        run = join(held)
        if len(run[names[0]]):
            yield run, first, False
            first = False
        held = [rest]
    if held:
        yield join(held), first, True


def _round_one(batches):
    names = ["core", "stretch", "doc", "seq", "start", "more"]
    out = ["doc", "seq", "start", "more", "open"]
    for g, is_first, is_last in _groups(batches, names):
        n = len(g["core"])
        if not n:
            continue
        new_core, new_stretch = np.ones(n, dtype=bool), np.ones(n, dtype=bool)
        new_core[1:] = g["core"][1:] != g["core"][:-1]
        new_stretch[1:] = new_core[1:] | (g["stretch"][1:] != g["stretch"][:-1])
        group = np.cumsum(new_core) - 1
        kinds = np.bincount(group, weights=new_stretch)
        unsettled = kinds > 1
        # groups at the borders of this task may go on in others
        if is_first:
            unsettled[0] = True
        if is_last:
            unsettled[-1] = True
        best = np.maximum.accumulate(np.where(new_stretch, np.arange(n), 0))
        repeats = ~new_stretch & ((g["doc"] != g["doc"][best]) | (g["seq"] != g["seq"][best]) | (g["start"] != g["start"][best]))
        opened = new_stretch & unsettled[group]
        kept = np.flatnonzero(repeats | opened)
        if len(kept):
            yield pa.RecordBatch.from_arrays([pa.array(g[c][kept]) for c in out[:4]] + [pa.array(opened[kept])], names=out)


def _round_two(batches):
    names = ["head", "tail", "doc", "seq", "start"]
    part = TaskContext.get().partitionId()
    last = None

    def rows(kind, g, at, flag):
        k = len(at)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(k, kind, np.int32)), *(pa.array(g[c][at]) for c in ("doc", "seq", "start", "head", "tail")), pa.array(np.full(k, part, np.int32)), pa.array(flag)],
            names=["kind", "doc", "seq", "start", "head", "tail", "part", "repeat"],
        )

    for g, is_first, _ in _groups(batches, names):
        n = len(g["head"])
        if not n:
            continue
        new = np.ones(n, dtype=bool)
        new[1:] = (g["head"][1:] != g["head"][:-1]) | (g["tail"][1:] != g["tail"][:-1])
        best = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        repeat = ~new & ((g["doc"] != g["doc"][best]) | (g["seq"] != g["seq"][best]) | (g["start"] != g["start"][best]))
        at = np.flatnonzero(repeat)
        if len(at):
            yield rows(0, g, at, repeat[at])
        if last is None:
            yield rows(1, g, np.array([0]), np.array([False]))
        last = g, np.array([n - 1]), repeat[[n - 1]]
    if last is not None:
        yield rows(2, *last)


def _trim(texts: list[bytes], spans: list) -> Iterator[tuple[bytes, int]]:
    """What is left of each text without the strings that the spans name, and the number of removed runs."""
    for text, packed in zip(texts, spans):
        if packed is None or not len(packed):
            yield text, 0
            continue
        starts = np.sort(np.asarray(packed, dtype=np.int64))
        low, high = starts >> 7, (starts >> 7) + (starts & 127) + LENGTH
        reach = np.maximum.accumulate(high)
        fresh = np.ones(len(low), dtype=bool)
        fresh[1:] = low[1:] > reach[:-1]
        begin = low[fresh]
        end = reach[np.append(np.flatnonzero(fresh)[1:], len(low)) - 1]
        keep = zip([0, *end.tolist()], [*begin.tolist(), len(text)])
        yield b"".join(text[a:b] for a, b in keep), len(begin)


def _numbered(docs: DataFrame) -> DataFrame:
    """Documents as doc (null id: before all others), seq and text. Rows that share an id but not a text are told apart by seq, in order of their texts."""
    rows = docs.withColumn("__doc", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))).withColumn("__raw", F.encode(F.coalesce(F.col("text").cast("string"), F.lit("")), "UTF-8"))
    clash = rows.groupBy("__doc").agg(F.min(F.xxhash64("__raw")).alias("a"), F.max(F.xxhash64("__raw")).alias("b")).where("a != b").limit(1).count()
    if not clash:
        return rows.withColumn("__seq", F.lit(0))
    from pyspark.sql import Window

    return rows.withColumn("__seq", F.dense_rank().over(Window.partitionBy("__doc").orderBy("__raw")) - 1)


def repeated_starts(rows: DataFrame) -> DataFrame:
    """``__doc, __seq, spans``: the repeated 100-byte strings of each text, packed as start * 128 + further starts."""

    def sample(batches):
        for batch in batches:
            doc, seq = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for core, stretch, text, low, more in samples(batch.column(2).to_pylist()):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(core), pa.array(stretch), pa.array(doc[text]), pa.array(seq[text]), pa.array(low.astype(np.int32)), pa.array(more.astype(np.int32))],
                    names=["core", "stretch", "doc", "seq", "start", "more"],
                )

    keys = ["core", "stretch", "doc", "seq", "start"]
    ranked = rows.select("__doc", "__seq", "__raw").mapInArrow(lean(sample, _tables.cache_clear), "core long, stretch long, doc long, seq int, start int, more int")
    one = materialize(ranked.repartitionByRange(*keys).sortWithinPartitions(*keys).mapInArrow(lean(_round_one), "doc long, seq int, start int, more int, open boolean"), "repeats-1")

    packed = (F.col("start").cast("long") * 128 + F.col("more")).alias("p")
    opened = one.where("open").groupBy(F.col("doc").alias("__doc"), F.col("seq").alias("__seq")).agg(F.collect_list(packed).alias("__spans"))

    def pairs(batches):
        for batch in batches:
            doc, seq = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for i, (text, spans) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())):
                spans = np.sort(np.array(spans, dtype=np.int64))
                for at in range(0, len(text), BLOCK):
                    here = spans[(spans >> 7 >= at) & (spans >> 7 < at + BLOCK)]
                    if not len(here):
                        continue
                    low, count = here >> 7, (here & 127) + 1
                    start = np.repeat(low - (np.cumsum(count) - count), count) + np.arange(count.sum())
                    prints = Fingerprints(np.frombuffer(text[at : at + BLOCK + WIDTH + LENGTH], dtype=np.uint8))
                    begin = start - at
                    head, tail = prints.of(begin, begin + LENGTH // 2), prints.of(begin + LENGTH // 2, begin + LENGTH)
                    n = len(start)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(head.view(np.int64)), pa.array(tail.view(np.int64)), pa.array(np.full(n, doc[i])), pa.array(np.full(n, seq[i])), pa.array(start.astype(np.int32))],
                        names=["head", "tail", "doc", "seq", "start"],
                    )

    keys = ["head", "tail", "doc", "seq", "start"]
    expanded = rows.select("__doc", "__seq", "__raw").join(opened, ["__doc", "__seq"]).select("__doc", "__seq", "__raw", "__spans").mapInArrow(lean(pairs, _tables.cache_clear), "head long, tail long, doc long, seq int, start int")
    found = "kind int, doc long, seq int, start int, head long, tail long, part int, repeat boolean"
    two = materialize(expanded.repartitionByRange(*keys).sortWithinPartitions(*keys).mapInArrow(lean(_round_two), found), "repeats-2")

    # a task's first string is a repeat if an earlier task ended within the same string at another position
    ended = F.broadcast(two.where("kind = 2").select("head", "tail", *(F.col(c).alias(f"e_{c}") for c in ("doc", "seq", "start", "part", "repeat"))))  # one row per task
    other = (F.col("e_doc") != F.col("doc")) | (F.col("e_seq") != F.col("seq")) | (F.col("e_start") != F.col("start")) | F.col("e_repeat")
    straddling = two.where("kind = 1").join(ended, ["head", "tail"]).where((F.col("e_part") < F.col("part")) & other)
    starts = (
        one.where("not open").select("doc", "seq", packed)
        .unionAll(two.where("kind = 0").select("doc", "seq", (F.col("start").cast("long") * 128).alias("p")))
        .unionAll(straddling.select("doc", "seq", (F.col("start").cast("long") * 128).alias("p")))
    )
    return starts.groupBy(F.col("doc").alias("__doc"), F.col("seq").alias("__seq")).agg(F.collect_list("p").alias("__spans"))


def remove_repeats(docs: DataFrame, *, keep: tuple[str, ...] = (), with_text: bool = False) -> DataFrame:
    """Texts without the 100-byte strings that also start earlier.

    ``doc_id, n_bytes, n_removed, n_spans, kept_sha256``, the columns of ``docs`` named in ``keep``,
    and with ``with_text`` the remaining text (characters that a border cuts are dropped). Earlier
    means in a smaller doc_id, or in the same text at a smaller offset; a null id comes before all.
    Rows with equal id and text are one document, and each gets its result; rows that share only the
    id are separate documents in order of their texts. Null and empty texts, and texts under 100
    bytes, lose nothing. Other columns are ignored. An empty table gives an empty result.
    """
    rows = _numbered(docs.select("doc_id", "text", *(F.col(c).alias(f"__keep_{c}") for c in keep)))
    spans = repeated_starts(rows)
    joined = rows.join(spans, ["__doc", "__seq"], "left").select("__raw", "__spans", F.col("doc_id").cast("long").alias("doc_id"), *(f"__keep_{c}" for c in keep))
    extra = [f"`__keep_{c}` {joined.schema[f'__keep_{c}'].dataType.simpleString()}" for c in keep] + ["text string"] * with_text

    def trim(batches):
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *(f"__keep_{c}" for c in keep), *["text"] * with_text]
        for batch in batches:
            raw = batch.column(0).to_pylist()
            left = list(_trim(raw, batch.column(1).to_pylist()))
            cols = [
                batch.column(2), pa.array([len(r) for r in raw], pa.int64()), pa.array([len(r) - len(x) for r, (x, _) in zip(raw, left)], pa.int64()),
                pa.array([k for _, k in left], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x, _ in left], pa.string()), *batch.columns[3:],
            ]
            if with_text:
                cols.append(pa.array([x.decode("utf-8", "ignore") for x, _ in left], pa.string()))
            yield pa.RecordBatch.from_arrays(cols, names=names)

    out = joined.mapInArrow(lean(trim), ", ".join(["doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string", *extra]))
    return out.select(*(F.col(c).alias(c.removeprefix("__keep_")) for c in out.columns))
