"""Running totals and greedy packing of ordered groups that may be far larger than one task.

Rows are cut into blocks, ranges of (keys, order), so that a group of any size is spread over many
tasks. What passes from block to block is small: a total per group and block for running totals; for
packing a table that says, for each place where the last chunk of the block before may be full, how
many chunks start in this block and where its own last one is full. These tables are composed in a
tree, so that no task sees more than ``FAN`` of them.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from missiva.session import materialize

FAN = 64
MAP = "chain long, node long, upto long, full long, n long"
ENTRY = "chain long, node long, full long, n long"


def blocks_of(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, blocks: int | None = None) -> DataFrame:
    """``df``, written once, with ``__block`` (a range of keys and order) and ``__value``: ``value``, null and negative ones as 0."""
    by = [F.col(c) for c in (*keys, *order)]
    ranged = df.repartitionByRange(blocks, *by) if blocks else df.repartitionByRange(*by)
    counted = F.greatest(F.lit(0), F.coalesce(F.col(value), F.lit(0))).cast("long")
    return materialize(ranged.withColumn("__block", F.spark_partition_id()).withColumn("__value", counted), "ranges")


def offsets(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per group and block: rows and total of the blocks before, the block's place in its group, the group's first block and its blocks."""
    sums = rows.groupBy(*keys, "__block").agg(F.sum("__value").alias("__sum"), F.count("*").alias("__rows"))
    w = Window.partitionBy(*keys)
    before = w.orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    return sums.select(
        *keys, "__block", F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__base"), F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__skip"),
        (F.row_number().over(w.orderBy("__block")) - 1).cast("long").alias("__node"), F.min("__block").over(w).cast("long").alias("__chain"), F.count("*").over(w).alias("__parts"),
    )


def same(keys: Sequence[str], a: str, b: str):
    """Equal keys and block, nulls being equal."""
    test = F.col(f"{a}.__block") == F.col(f"{b}.__block")
    for k in keys:
        test = test & F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}"))
    return test


def placed(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """``rows`` with ``running`` (the total up to and with each row), ``rn`` (from 1), and their block's place, by sums in two levels."""
    at = offsets(rows, keys)
    both = rows.alias("r").join(at.alias("o"), same(keys, "r", "o")).select("r.*", *(f"o.{c}" for c in at.columns if c.startswith("__") and c != "__block"))
    # equal orders stand by value, so that the totals do not depend on how rows arrive
    w = Window.partitionBy(*keys, "__block").orderBy(*order, "__value").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumns({"running": F.sum("__value").over(w) + F.col("__base"), "rn": F.count("*").over(w) + F.col("__skip")})


def running_totals(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, blocks: int | None = None) -> DataFrame:
    """``df`` with ``running`` and ``rn``: the total of ``value`` over the rows of a group up to and with each row, and its number from 1.

    Null keys are one group, null orders come first, null and negative values count as 0, rows of equal
    order stand by value. ``df`` is written once, so give it the columns that are needed. Columns named
    ``running`` or ``rn`` are replaced.
    """
    df = df.drop("running", "rn")
    return placed(blocks_of(df, keys, order, value, blocks), keys, order).select(*df.columns, "running", "rn")


def following(ends: np.ndarray, begins: np.ndarray, most: int) -> np.ndarray:
    """For each message the first one that its chunk cannot take if the chunk starts with it: ``len(ends)`` if none."""
    return np.maximum(np.searchsorted(ends, begins + most, side="right"), np.arange(1, len(ends) + 1))


def block_map(ends: np.ndarray, begins: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What one block does with the chunk that comes into it.

    A chunk is full at ``full``: it takes messages that end by then (-1: none). ``upto`` ascends; a chunk
    that is full before ``upto[k]`` and not before ``upto[k - 1]`` is followed by ``n[k]`` chunks that
    start in the block, the last full at ``full[k]``. One full at or after the last ``upto`` takes all.
    """
    size = len(ends)
    after = following(ends, begins, most)
    last, n = np.where(after < size, after, np.arange(size)), (after < size).astype(np.int64)
    while True:
        twice = last[last]
        if np.array_equal(twice, last):
            break
        n, last = n + n[last], twice
    full = np.where(ends[last] - begins[last] > most, -1, begins[last] + most)
    # no chunk that starts before the block is full later than this
    reach = np.concatenate(([True], ends[:-1] <= begins[0] + most))
    return shortened(ends[reach], full[reach], n[reach] + 1)


def shortened(upto: np.ndarray, full: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same table with one row for neighbours that lead to the same."""
    keep = np.concatenate(((full[1:] != full[:-1]) | (n[1:] != n[:-1]), [True]))
    return upto[keep], full[keep], n[keep]


def through(table: tuple, full: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Chunks full at ``full``, with ``n`` started so far, after a block."""
    upto, out, more = table
    k = np.searchsorted(upto, full, side="right")
    inside = k < len(upto)
    k = np.minimum(k, len(upto) - 1)
    return np.where(inside, out[k], full), np.where(inside, n + more[k], n)


def composed(tables: list[tuple], most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The table of neighbouring blocks as one."""
    upto = np.unique(np.concatenate([t[0] for t in tables]))
    first = tables[0][0][0]
    upto = upto[np.concatenate(([True], upto[:-1] <= first + most))]
    full, n = upto - 1, np.zeros(len(upto), np.int64)
    for t in tables:
        full, n = through(t, full, n)
    return shortened(upto, full, n)


def tables_of(table: pa.Table) -> tuple[np.ndarray, list[tuple]]:
    """Nodes of an Arrow table of maps in order, and their tables."""
    node, upto, full, n = (table.column(c).to_numpy() for c in ("node", "upto", "full", "n"))
    by = np.lexsort((upto, node))
    node, upto, full, n = node[by], upto[by], full[by], n[by]
    nodes, at = np.unique(node, return_index=True)
    return nodes, list(zip(np.split(upto, at[1:]), np.split(full, at[1:]), np.split(n, at[1:]), strict=True))


def entries(maps: DataFrame, longest: int, most: int) -> DataFrame:
    """``chain, node, full, n``: where the chunk that comes into each block is full and how many have started before it."""

    def up(key, table):
        upto, full, n = composed(tables_of(table)[1], most)
        size = len(upto)
        return pa.table({"chain": pa.array([key[0].as_py()] * size, pa.int64()), "node": pa.array([key[1].as_py()] * size, pa.int64()), "upto": upto, "full": full, "n": n})

    def down(key, table):
        nodes, tables = tables_of(table)
        full, n = np.array([table.column("in_full")[0].as_py()]), np.array([table.column("in_n")[0].as_py()])
        rows = []
        for t in tables:
            rows.append((full[0], n[0]))
            full, n = through(t, full, n)
        return pa.table({"chain": pa.array([key[0].as_py()] * len(nodes), pa.int64()), "node": nodes, "full": pa.array([r[0] for r in rows], pa.int64()), "n": pa.array([r[1] for r in rows], pa.int64())})

    parent = F.floor(F.col("node") / FAN).cast("long")
    levels = [maps]
    while longest > FAN:
        levels.append(materialize(levels[-1].withColumn("up", parent).groupBy("chain", "up").applyInArrow(up, MAP), "ranges-maps"))
        longest = -(-longest // FAN)
    into = levels[-1].select("chain", F.lit(0).cast("long").alias("up"), F.lit(-1).cast("long").alias("in_full"), F.lit(0).cast("long").alias("in_n")).distinct()
    for level in reversed(levels):
        told = level.withColumn("up", parent).join(into, ["chain", "up"]).groupBy("chain", "up").applyInArrow(down, ENTRY)
        into = told.select("chain", F.col("node").alias("up"), F.col("full").alias("in_full"), F.col("n").alias("in_n"))
    return told


def pack(df: DataFrame, keys: Sequence[str], order: Sequence[str], length: str, most: int, blocks: int | None = None) -> DataFrame:
    """``keys, order, length, chunk``: chunk numbers, from 1, of each group's rows packed greedily in order.

    A chunk takes rows while their lengths come to at most ``most``; a longer row is a chunk by itself.
    Null and negative lengths count as 0, null keys are one group, null orders come first, rows of equal
    order stand by length. A group is cut into blocks, and no task holds more than one block's keys,
    orders and lengths; give ``blocks`` where the session's number of shuffle partitions makes them too large.
    """
    cols = [*keys, *order, length]
    rows = blocks_of(df.select(*cols), keys, order, length, blocks)
    at = placed(rows, keys, order).select(*cols, "__block", "__chain", "__node", "__parts", "__value", "rn", "running")
    at = materialize(at, "ranges-placed")
    longest = at.agg(F.max("__parts")).first()[0] or 0

    def first_pass(key, table):
        value, running, rn = (table.column(c).to_numpy() for c in ("__value", "running", "rn"))
        by = np.argsort(rn)
        upto, full, n = block_map(running[by], running[by] - value[by], most)
        return pa.table({"chain": pa.array([key[0].as_py()] * len(upto), pa.int64()), "node": pa.array([key[1].as_py()] * len(upto), pa.int64()), "upto": upto, "full": full, "n": n})

    if longest > 1:
        many = at.where("__parts > 1").select("__chain", "__node", "__value", "rn", "running")
        maps = materialize(many.groupBy("__chain", "__node").applyInArrow(first_pass, MAP), "ranges-maps")
        into = entries(maps, longest, most).where("node > 0")
        named = at.where("__parts > 1").select("__block", F.col("__chain").alias("chain"), F.col("__node").alias("node")).distinct()
        into = named.join(into, ["chain", "node"]).select("__block", F.col("chain").alias("__chain"), F.col("full").alias("__full"), F.col("n").alias("__n"))
        at = at.join(into, ["__block", "__chain"], "left")
    else:
        at = at.withColumns({"__full": F.lit(None).cast("long"), "__n": F.lit(None).cast("long")})
    schema = [f for f in df.schema.fields if f.name in cols]
    names = [f.name for f in schema]

    def second_pass(table):
        table = table.sort_by([("__group", "ascending"), ("rn", "ascending")])
        value, running, group = (table.column(c).to_numpy() for c in ("__value", "running", "__group"))
        size = len(value)
        heads = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
        group = group - 1
        # one line for all groups of the block, one behind another; a chunk ends with its group
        line = np.cumsum(value)
        begins, limit = line - value, np.append(heads[1:], size)
        after = np.minimum(following(line, begins, most), limit[group]).tolist()
        start, i, before = np.zeros(size, np.int64), 0, 0
        came = table.column("__full")[0].as_py()
        if came is not None:  # the first group goes on from the block before
            before = table.column("__n")[0].as_py()
            i = int(np.searchsorted(running[: limit[0]], came, side="right"))
        while i < size:
            start[i] = 1
            i = after[i]
        count = np.cumsum(start)
        base = np.where(heads > 0, count[heads - 1], 0)[group]
        chunk = count - base + np.where(group == 0, before, 0)
        return table.select(names).append_column("chunk", pa.array(chunk, pa.int64()))

    # a block's groups by number, the one that comes from another block first
    number = F.dense_rank().over(Window.partitionBy("__block").orderBy(F.col("__full").isNull(), *keys))
    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema) + ", chunk long"
    got = at.withColumn("__group", number).select(*names, "__block", "__group", "__value", "rn", "running", "__full", "__n")
    return got.groupBy("__block").applyInArrow(second_pass, out).select(*cols, "chunk")
