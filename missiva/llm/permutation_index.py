"""Approximate nearest neighbours by a permutation index.

A vector is represented by the order of its nearest pivots. Segments of bounded size hold, for every
pivot, the list of vectors that have it among their nearest, with its place (the pivot's inverted
file). A query reads the lists of its own nearest pivots and adds up, per vector, how far the places
are apart (footrule distance, absent pivots at the end of the order); the best share of the segment,
and all whose order is close to the query's, are ranked again by exact inner product. Every query meets every segment, so the share, and with it
recall, does not depend on the size of the table, and a hot pivot only makes one list of a segment
longer. Pivots are the only sample; every vector is indexed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from missiva.session import materialize

#: Pivots (from a sample of four times as many by hash of the id), places kept, share of a segment ranked exactly, sizes.
PIVOTS, PLACES, SHARE, SEGMENT, QUERY_BLOCK = 256, 64, 0.25, 8192, 1024
#: Vectors whose order is so alike are always ranked exactly, however many: in a dense group orders say little.
CLOSE, PARALLEL = 0.6, 0.8


def _proper(vectors: DataFrame) -> DataFrame:
    """Ids and vectors that take part: not null, not zero, every component finite."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    good = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    return rows.where(F.col("vec_id").isNotNull() & good)


def spread(sample: np.ndarray) -> np.ndarray:
    """Up to PIVOTS vectors of the sample, in turn, none nearly parallel to one before: copies of a pivot would only add noise to the orders."""
    unit = sample / np.linalg.norm(sample, axis=1, keepdims=True)
    chosen: list[int] = []
    for i in range(len(sample)):
        if len(chosen) < PIVOTS and (not chosen or (unit[chosen] @ unit[i]).max() < PARALLEL):
            chosen.append(i)
    return sample[chosen]


def permutations(x: np.ndarray, pivots: np.ndarray, places: int) -> np.ndarray:
    """Nearest pivots of each vector, nearest first, ties to the earlier pivot."""
    return np.argsort(-(x @ pivots.T), axis=1, kind="stable")[:, :places].astype(np.int16)


class Segment:
    """Pivot inverted files of some vectors."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, order: np.ndarray, pivots: int):
        self.ids, self.x, self.places = ids, x, order.shape[1]
        flat = order.ravel().astype(np.int64)
        by = np.argsort(flat, kind="stable")
        self.posted = (by // self.places).astype(np.int32)
        self.place = (by % self.places).astype(np.int32)
        self.bounds = np.searchsorted(flat[by], np.arange(pivots + 1))

    def search(self, query_id: int, q: np.ndarray, order: np.ndarray, k: int, share: float) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best of the candidates, best first, ties to the smaller id."""
        # footrule distance up to a constant: a shared pivot saves the places it is nearer than the end of either order
        saved = np.zeros(len(self.ids), dtype=np.int32)
        for place, pivot in enumerate(order.tolist()):
            a, b = self.bounds[pivot], self.bounds[pivot + 1]
            there = self.place[a:b]
            saved[self.posted[a:b]] += (self.places - place) + (self.places - there) - np.abs(there - place)
        n = len(self.ids)
        most = min(n, max(8 * k, int(np.ceil(share * n))))
        full = self.places * (self.places + 1)  # what an equal order saves
        cut = np.partition(saved, n - most)[n - most]
        near = np.flatnonzero(saved >= min(cut, CLOSE * full))
        near = near[self.ids[near] != query_id]
        score = (self.x[near] * q).sum(axis=1)
        best = np.lexsort((self.ids[near], -score))[:k]
        return self.ids[near[best]], score[best]


def search(vectors: DataFrame, *, every: int = 20, k: int = 20, share: float = SHARE) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the k nearest found of each query, by largest inner product.

    Queries are the rows whose vec_id is a multiple of ``every``; candidates are all rows but those
    of the query's own id. Vectors that are null, zero or hold null or non-finite components, and null
    ids, take no part. Rows that repeat an id with another vector are separate candidates and queries,
    each with its own list; equal rows count once.
    Vectors are of one length (others raise). Ties go to the smaller id. Other columns are ignored.
    An empty table gives an empty result.
    """
    spark = vectors.sparkSession
    rows = _proper(vectors)
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(4 * PIVOTS).collect()
    if not sample:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    pivots = spread(np.array([r.v for r in sample]))
    places = min(PLACES, len(pivots))
    count = rows.count()
    segments = -(-count // SEGMENT)

    def pack(table: pa.Table) -> pa.Table:
        ids = table.column("vec_id").to_numpy()
        x = np.array(table.column("v").to_pylist())
        # by id, then vector; equal rows once
        by = np.lexsort((*x.T[::-1], ids))
        fresh = np.ones(len(by), dtype=bool)
        fresh[1:] = (ids[by[1:]] != ids[by[:-1]]) | (x[by[1:]] != x[by[:-1]]).any(axis=1)
        by = by[fresh]
        order = permutations(x[by], pivots, places)
        return pa.table({"part": [table.column("part")[0].as_py()], "ids": [ids[by].tobytes()], "x": [x[by].tobytes()], "places": [order.tobytes()]}, schema=schema)

    schema = pa.schema([("part", pa.int64()), ("ids", pa.binary()), ("x", pa.binary()), ("places", pa.binary())])
    packed = "part long, ids binary, x binary, places binary"
    hashed = lambda seed, n: F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(n))
    index = materialize(rows.withColumn("part", hashed(1, segments)).groupBy("part").applyInArrow(pack, packed), "index")
    asked = rows.where(F.col("vec_id") % every == 0)
    blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    queries = materialize(asked.withColumn("part", hashed(2, blocks)).groupBy("part").applyInArrow(pack, packed), "queries")
    queries = queries.select(F.col("part").alias("block"), F.col("ids").alias("q_ids"), F.col("x").alias("q_x"), F.col("places").alias("q_places"))
    pairs = index.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))).join(
        queries.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(segments - 1).cast("long")))), ["part", "block"]
    )
    dim = pivots.shape[1]

    def meet(batches):
        for batch in batches:
            for row in batch.to_pylist():
                read = lambda p: (np.frombuffer(row[f"{p}ids"], np.int64), np.frombuffer(row[f"{p}x"]).reshape(-1, dim), np.frombuffer(row[f"{p}places"], np.int16).reshape(-1, places))
                segment = Segment(*read(""), len(pivots))
                q_ids, q_x, q_order = read("q_")
                found = [segment.search(i, q, o, k, share) for i, q, o in zip(q_ids.tolist(), q_x, q_order)]
                size = [len(f[0]) for f in found]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat((row["block"] << 32) + np.arange(len(q_ids)), size)), pa.array(np.repeat(q_ids, size)), pa.array(np.concatenate([f[0] for f in found])), pa.array(np.concatenate([f[1] for f in found]))],
                    names=["query", "query_id", "vec_id", "score"],
                )

    met = pairs.select("block", "ids", "x", "places", "q_ids", "q_x", "q_places").mapInArrow(meet, "query long, query_id long, vec_id long, score double")
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    return met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
