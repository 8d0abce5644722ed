"""Message index operators: selection, resume, reconciliation, versions, budgets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from missiva.operators.ranges import running_totals


def latest(df: DataFrame, keys: Sequence[str], *order: str) -> DataFrame:
    """Last row of each key in the given order (last write wins)."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__row"))
    return best.select(*keys, *(F.col(f"__row.{c}").alias(c) for c in rest))


def index_summary(index: DataFrame, folder: str = "folder", key: str = "message_id") -> DataFrame:
    """Messages and distinct real ids per folder and in all (synthetic ids start with ``uid_``)."""
    real = F.when(~F.startswith(F.col(key), F.lit("uid_")), F.col(key))
    counts = index.groupingSets([[F.col(folder)], []], F.col(folder)).agg(F.count("*").alias("messages"), F.countDistinct(real).alias("unique_ids"), F.grouping_id().alias("g"))
    return counts.select(F.when(F.col("g") == 0, F.col(folder)).otherwise("(all)").alias("folder"), "messages", "unique_ids")


def in_window(day: Column, size: Column, first: str | None, last: str | None, least: int = 0) -> Column:
    """Inclusive day window and least size; undated rows fall out only if a bound is set."""
    dated = F.lit(True)
    if first is not None or last is not None:
        dated = day.isNotNull() & (day >= (first or "")) & (day <= (last or "9999-99-99"))
    return dated & (size >= least)


def top_per_group(df: DataFrame, group: Sequence[str], order: Sequence[Column], n: int, rank: str = "rank") -> DataFrame:
    """First n rows of each group in an order, with their rank."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col(rank) <= n)


def reconcile(index: DataFrame, disk: DataFrame, most: int = 50) -> DataFrame:
    """Per folder: indexed and present files, missing and orphaned ones, with up to ``most`` names of each."""
    both = index.select("folder", "path", F.lit(1).alias("i")).join(disk.select("folder", "path", F.lit(1).alias("d")), ["folder", "path"], "full_outer")
    missing, orphan = F.col("d").isNull(), F.col("i").isNull()
    counts = both.groupBy("folder").agg(F.count("i").alias("indexed"), F.count("d").alias("on_disk"), F.count_if(missing).alias("n_missing"), F.count_if(orphan).alias("n_orphans"))
    # only files without a partner are ranked
    odd = both.where(missing | orphan).select("folder", "path", missing.alias("gone"))
    odd = odd.withColumn("k", F.row_number().over(Window.partitionBy("folder", "gone").orderBy("path"))).where(F.col("k") <= most)
    name = lambda flag: F.array_sort(F.collect_list(F.when(flag, F.col("path"))))
    named = odd.groupBy("folder").agg(name(F.col("gone")).alias("missing"), name(~F.col("gone")).alias("orphans"))
    none, ok = F.array().cast("array<string>"), (F.col("n_missing") == 0) & (F.col("n_orphans") == 0)
    return counts.join(named, "folder", "left").select("folder", "indexed", "on_disk", "n_missing", "n_orphans", F.coalesce("missing", none).alias("missing"), F.coalesce("orphans", none).alias("orphans"), ok.alias("ok"))


def admit(df: DataFrame, group: Sequence[str], order: Sequence[str], cost: str, budget: int) -> DataFrame:
    """Rows of each group in order while their running cost stays within the budget; the first always.

    Groups may be of any size: see ``ranges.running_totals``, whose ``running`` and ``rn`` are added.
    """
    return running_totals(df, group, order, cost).where((F.col("running") <= budget) | (F.col("rn") == 1))


def coverage(current: DataFrame, recorded: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Status of each thread: pending without a record, stale if its signature (n, last_day) differs, else done."""
    old = recorded.select(*keys, F.col("n").alias("old_n"), F.col("last_day").alias("old_day"), F.lit(True).alias("seen"))
    same = F.col("n").eqNullSafe(F.col("old_n")) & F.col("last_day").eqNullSafe(F.col("old_day"))
    return current.join(old, list(keys), "left").withColumn("state", F.when(F.col("seen").isNull(), "pending").when(same, "done").otherwise("stale")).drop("old_n", "old_day", "seen")
