"""Connected components of an edge table, as a loop of joins and partial aggregations."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, IntegerType, LongType, ShortType, StringType

from missiva.session import materialize, sized

#: Edges, and bytes of them, that a task contracts at a time.
CHUNK = (200_000, 1 << 24)


def _roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The least node of the component of each of the nodes 0 to n - 1."""
    root = np.arange(n)
    while len(a):
        x, y = root[a], root[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(ahead := root[root], root):
            root = ahead
    return root


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``node, root``: each node of a chunk of edges with the least node that this chunk's edges join it to."""

    def stars(held):
        ends = pa.concat_arrays([x.column(i) for i in (0, 1) for x in held]).dictionary_encode()
        order = pc.sort_indices(ends.dictionary)
        place = np.empty(len(order), dtype=np.int64)
        place[order.to_numpy()] = np.arange(len(order))
        a, b = np.split(place[ends.indices.to_numpy()], 2)
        names = ends.dictionary.take(order)
        made = pa.RecordBatch.from_arrays([names, names.take(pa.array(_roots(a, b, len(order))))], names=["node", "root"])
        for at in range(0, len(order), 20_000):
            yield made.slice(at, 20_000)

    held, rows, size = [], 0, 0
    for batch in batches:
        held.append(batch)
        rows, size = rows + batch.num_rows, size + batch.nbytes
        if rows >= CHUNK[0] or size >= CHUNK[1]:
            yield from stars(held)
            held, rows, size = [], 0, 0
    if rows:
        yield from stars(held)


def contracted(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """``node, root``: the edges as stars, made chunk by chunk where they lie, without a shuffle; nodes of several chunks have several roots."""
    ends = edges.select(F.col(src).alias("node"), F.col(dst).alias("root")).where("node is not null and root is not null")
    kind = ends.schema["node"].dataType
    if kind == ends.schema["root"].dataType and (isinstance(kind, (ByteType, ShortType, IntegerType, LongType)) or kind == StringType()):
        return ends.mapInArrow(_stars, ends.schema)
    low = F.least("node", "root")
    return ends.select(F.greatest("node", "root").alias("node"), low.alias("root")).unionAll(ends.select(low, low))


def _met(stars: DataFrame, max_rounds: int = 100) -> DataFrame:
    """``node, component`` of stars (``node, root``; a root is a node of its own star), whose roots are joined where they share a node.

    A node stands once in a chunk, so that it has no more rows than there are chunks.
    """
    mine = Window.partitionBy("node").orderBy("root")
    ranked = stars.select("node", "root", F.first("root").over(mine).alias("component"), F.row_number().over(mine).alias("k")).where("k = 1 or root <> component")
    marked = materialize(ranked.select("node", "component", F.when(F.col("k") > 1, F.col("root")).alias("other")), "stars")
    labels = marked.where("other is null").select("node", "component")
    live = marked.where("other is not null").select("other", "component")
    if live.isEmpty():
        return labels
    above = connected_components(live.distinct(), "other", "component", max_rounds)
    named = labels.join(above.select(F.col("node").alias("component"), F.col("component").alias("__to")), "component", "left")
    return materialize(named.select("node", F.coalesce("__to", "component").alias("component")), "labels")


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 100, together: bool = False) -> DataFrame:
    """``node, component``: the least node of each node's component.

    ``together`` says that the edges of a component mostly lie beside each other: each task then joins
    what it can of its own edges first, and only what is left between tasks goes through the rounds.
    The result is the same.

    Each round hooks the component of every edge's end to the least component beside it, then halves
    the chains of hooks by joining the parent table with itself, so a path of n nodes takes about
    log2(n) rounds. Minima are taken by partial aggregation and a star's centre is an ordinary key of
    skew-splittable joins, so hubs need no group in one task. Every round is written to the shared
    scratch folder; edges inside one component are dropped as soon as they are. Nodes are those of
    the edges; null ends and self-loops add none but themselves. Direction and repeats do not matter.
    An empty table gives an empty result.
    """
    if together:
        return _met(contracted(edges, src, dst), max_rounds)
    live = materialize(edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a is not null and b is not null"), "edges")
    rows = 2 * live.count()
    step = lambda df, tag: materialize(sized(df, rows), tag)
    parents = step(live.select(F.col("a").alias("node")).unionAll(live.select("b")).distinct().withColumn("component", F.col("node")), "labels")
    live = live.where("a != b")
    for _ in range(max_rounds):
        if live.isEmpty():
            return parents
        # a and b are roots: hook every root to the least root beside it, if that is less
        both = live.select(F.col("a").alias("root"), F.col("b").alias("near")).unionAll(live.select("b", "a"))
        hooks = step(both.groupBy("root").agg(F.min("near").alias("to")).where("to < root"), "hooks")
        # follow hooks to their ends by pointer jumping
        while True:
            ahead = hooks.select(F.col("root").alias("to"), F.col("to").alias("next"))
            jumped = step(hooks.join(ahead, "to", "left").select("root", F.coalesce("next", "to").alias("to"), F.col("next").isNotNull().alias("moved")), "jump")
            hooks = jumped.select("root", "to")
            if jumped.where("moved").isEmpty():
                break
        follow = lambda df, c: (
            df.join(hooks.select(F.col("root").alias(c), F.col("to").alias("__to")), c, "left").withColumn(c, F.coalesce("__to", c)).drop("__to")
        )
        parents = step(follow(parents, "component").select("node", "component"), "labels")
        live = step(follow(follow(live, "a"), "b").where("a != b").select("a", "b").distinct(), "edges")
    raise RuntimeError("components did not settle")


def extend_components(labels: DataFrame, edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """``labels`` (``node, component``) after further edges: only the components that the edges join are worked on again.

    The labels are stars like those of the edges, so both meet in one shuffle by node. New nodes join.
    The component of a node stays the least node of it.
    """
    return _met(contracted(edges, src, dst).unionAll(labels.select("node", "component")))
