"""Quality classifier: kernel ridge on random Fourier features, with isotonic calibration.

Each text becomes a short vector of statistics (shares of character classes, repeats of words and
lines, lengths). Random cosine features of the standardised vector approximate a Gaussian kernel.
Every partition adds its rows to normal equations (one set per fold), the sums are small whatever
the input, and the ridge weights follow from them. Raw scores of rows by the model that has not
seen their fold are binned, and pooling adjacent violators over the bins makes them a monotone
probability.
"""

from __future__ import annotations

from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from missiva.session import materialize

NAMES = (
    "log_bytes", "log_words", "word_bytes", "long_words", "distinct_words", "distinct_pairs", "same_as_last",
    "repeated_lines", "words_a_line", "upper", "digits", "marks", "bangs", "stops", "bars", "high_bytes", "entropy", "top_byte",
)
#: Random features, ridge penalty per row, folds, bins of the calibration, seed.
FEATURES, PENALTY, FOLDS, BINS, SEED = 128, 1e-3, 4, 400, 11
LOW, HIGH = -0.5, 1.5


def statistics(text: str) -> list[float]:
    """The vector of one text; an empty text has a vector of zeros."""
    raw = text.encode("utf-8")
    n = len(raw)
    words = raw.split()
    w = len(words)
    if not w:
        return [0.0] * len(NAMES)
    counts = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
    share = counts / n
    some = share[share > 0]
    lines = [x for x in raw.split(b"\n") if x]
    return [
        float(np.log1p(n)), float(np.log1p(w)), n / w, sum(len(x) > 20 for x in words) / w,
        len(set(words)) / w, len(set(zip(words, words[1:]))) / max(1, w - 1), sum(map(eq, words, words[1:])) / w,
        1 - len(set(lines)) / max(1, len(lines)), float(np.log1p(w / max(1, len(lines)))),
        float(share[65:91].sum()), float(share[48:58].sum()), float(share[[35, 36, 37, 38, 42, 60, 62]].sum()), float(share[33]),
        float(share[[44, 46]].sum()), float(share[124]), float(share[128:].sum()), float(-(some * np.log2(some)).sum()), float(share.max()),
    ]


def text_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and one column per statistic; narrow, one row per input row."""

    def run(batches):
        for batch in batches:
            x = np.array([statistics(t or "") for t in batch.column(1).to_pylist()], dtype=np.float64).reshape(-1, len(NAMES))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x[:, i]) for i in range(len(NAMES)))], names=["doc_id", *NAMES])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, " + ", ".join(f"{n} double" for n in NAMES))


def held_out(col: str = "doc_id"):
    """Rows that are never learned from: crc32 of the id as text is a multiple of 5. A row without id is held out."""
    return F.coalesce(F.crc32(F.col(col).cast("string")) % 5 == 0, F.lit(True))


class Basis:
    """Standardisation and random cosine features."""

    def __init__(self, mean: np.ndarray, std: np.ndarray):
        rng = np.random.default_rng(SEED)
        d = len(mean)
        self.mean, self.std = mean, np.where(std > 1e-9, std, 1.0)
        self.w = rng.normal(size=(d, FEATURES)) / np.sqrt(d)
        self.b = rng.uniform(0, 2 * np.pi, FEATURES)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.std, -4, 4)
        return np.hstack([np.sqrt(2 / FEATURES) * np.cos(z @ self.w + self.b), np.ones((len(x), 1))])


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return np.column_stack([batch.column(n).to_numpy(zero_copy_only=False) for n in NAMES]) if batch.num_rows else np.zeros((0, len(NAMES)))


def _normal_equations(rows: DataFrame, basis: Basis) -> np.ndarray:
    """Per fold, sums of [z y]' [z y] over its rows; tree of partition sums."""
    side = FEATURES + 2

    def add(batches):
        sums = np.zeros((FOLDS, side, side))
        for batch in batches:
            z = np.hstack([basis(_matrix(batch)), batch.column("y").to_numpy(zero_copy_only=False)[:, None]])
            fold = batch.column("fold").to_numpy(zero_copy_only=False)
            for k in range(FOLDS):
                sums[k] += z[fold == k].T @ z[fold == k]
        for k in range(FOLDS):
            yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([sums[k].tobytes()], pa.binary())], names=["fold", "sums"])

    def merge(batches):
        sums = np.zeros((FOLDS, side, side))
        for batch in batches:
            for k, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                sums[k] += np.frombuffer(s).reshape(side, side)
        for k in range(FOLDS):
            yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([sums[k].tobytes()], pa.binary())], names=["fold", "sums"])

    schema = "fold long, sums binary"
    total = np.zeros((FOLDS, side, side))
    for row in rows.mapInArrow(add, schema).repartition(8).mapInArrow(merge, schema).collect():  # at most 8 x FOLDS rows
        total[row.fold] += np.frombuffer(row.sums).reshape(side, side)
    return total


def _solve(sums: np.ndarray) -> np.ndarray:
    a, b, n = sums[:-1, :-1], sums[:-1, -1], max(1.0, sums[-2, -2])
    return np.linalg.solve(a + PENALTY * n * np.eye(len(a)), b)


def pool_adjacent(sums: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Isotonic fit: mean of each bin after pooling neighbours that would fall."""
    blocks: list[list[float]] = []
    for s, c in zip(sums, counts):
        blocks.append([float(s), float(c), 1])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            s2, c2, k = blocks.pop()
            blocks[-1] = [blocks[-1][0] + s2, blocks[-1][1] + c2, blocks[-1][2] + k]
    return np.concatenate([np.full(int(k), s / c) for s, c, k in blocks])


def score_quality(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.3, label_col: str = "quality") -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row of ``docs``.

    Learned from labelled rows that are not held out (several labels of one id count as their
    largest; null labels are ignored); without any, every score is 0.5. One row per input row,
    repeated rows included. Null and empty texts have a statistics vector of zeros and are scored
    like any other; a null id is held out. Ties share a score. Other columns are ignored. Empty
    tables give empty results.
    """
    stats = materialize(text_statistics(docs), "quality").withColumn("held_out", held_out())
    moments = stats.agg(*(f(n).alias(f"{k}_{n}") for n in NAMES for k, f in (("mean", F.avg), ("std", F.stddev_pop)))).first()
    of = lambda k: np.array([moments[f"{k}_{n}"] or 0.0 for n in NAMES])
    basis = Basis(of("mean"), of("std"))

    truth = labels.where(F.col(label_col).isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(label_col).cast("double").alias("y"))
    known = stats.where(~F.col("held_out")).join(truth, "doc_id").withColumn("fold", F.expr(f"cast(crc32(cast(doc_id as string)) div 5 % {FOLDS} as long)"))
    sums = _normal_equations(known, basis)
    whole = sums.sum(axis=0)
    if whole[-2, -2] < 1:
        return stats.select("doc_id", "held_out", F.lit(0.5).alias("score"), F.lit(1 if threshold <= 0.5 else 0).alias("predicted"))
    weights, apart = _solve(whole), np.stack([_solve(whole - s) for s in sums])

    def unseen(batches):
        for batch in batches:
            fold = batch.column("fold").to_numpy(zero_copy_only=False).astype(int)
            raw = (basis(_matrix(batch)) * apart[fold]).sum(axis=1)
            at = np.clip((raw - LOW) / (HIGH - LOW) * BINS, 0, BINS - 1).astype(np.int64)
            y = batch.column("y").to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(BINS)), pa.array(np.bincount(at, minlength=BINS)), pa.array(np.bincount(at, weights=y, minlength=BINS))], names=["bin", "n", "s"])

    bins = known.mapInArrow(unseen, "bin long, n long, s double").where("n > 0").groupBy("bin").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).orderBy("bin").collect()
    centres = LOW + (np.array([r.bin for r in bins]) + 0.5) / BINS * (HIGH - LOW)
    fitted = pool_adjacent(np.array([r.s for r in bins]), np.array([r.n for r in bins], dtype=float))

    def score(batches):
        for batch in batches:
            raw = basis(_matrix(batch)) @ weights
            p = np.clip(np.interp(raw, centres, fitted), 0, 1)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(p), pa.array((p >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return stats.mapInArrow(score, "doc_id long, held_out boolean, score double, predicted int")
