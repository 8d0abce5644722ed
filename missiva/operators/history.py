"""Identity of threads over time: what was recorded of a thread is found again after it has grown or merged.

A component's label is one of its nodes, so the labels of today tell where every earlier label has
gone: one join on the label, however many versions lie between.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def label_changes(old: DataFrame, new: DataFrame, version: int) -> DataFrame:
    """``component, now, version``: the components of ``old`` labels (``node, component``) that have another label in ``new``."""
    gone = old.select(F.col("component").alias("node")).distinct()
    return gone.join(new.select("node", F.col("component").alias("now")), "node").where("node <> now").select(F.col("node").alias("component"), "now", F.lit(version).alias("version"))


def name_log(rollup: DataFrame, version: int) -> DataFrame:
    """``thread_id, component, version``: the names of the threads of a rollup, to be added to the log of all versions."""
    return rollup.select("thread_id", "component", F.lit(version).alias("version"))


def names_now(log: DataFrame, labels: DataFrame) -> DataFrame:
    """The log with ``component`` as it is labelled now, and the first version under which each name was known; names of nodes that are no longer there are left out."""
    named = log.groupBy("thread_id", "component").agg(F.min("version").alias("version"))
    moved = named.join(labels.select(F.col("node").alias("component"), F.col("component").alias("now")), "component")
    return moved.groupBy("thread_id", F.col("now").alias("component")).agg(F.min("version").alias("version"))


def threads_with_records(rollup: DataFrame, records: DataFrame, log: DataFrame, labels: DataFrame) -> DataFrame:
    """``rollup`` with the newest record made under any name that its thread, or one that it has absorbed, ever had.

    ``records`` has ``thread_id, version, n, last_day``. Added are ``n_names`` and ``n_records`` of all its
    history, ``record_version`` and ``record_id`` of the newest record (of one version the largest, then the latest),
    and ``state``: pending without a record, done while the record's signature holds, else stale. Records
    under a name that the log does not know are left out.
    """
    names = names_now(log, labels)
    made = records.groupBy("thread_id").agg(F.count("*").alias("n"), F.max(F.struct("version", "n", "last_day", "thread_id")).alias("r"))
    # one row a name of a thread
    by = names.join(made, "thread_id", "left").groupBy("component").agg(F.count("thread_id").alias("n_names"), F.sum("n").alias("n_records"), F.max("r").alias("r"))
    same = F.col("n").eqNullSafe(F.col("r.n")) & F.col("last_day").eqNullSafe(F.col("r.last_day"))
    state = F.when(F.col("r").isNull(), "pending").when(same, "done").otherwise("stale")
    return rollup.join(by, "component", "left").select(
        *rollup.columns, F.coalesce("n_names", F.lit(0)).alias("n_names"), F.coalesce("n_records", F.lit(0)).alias("n_records"), F.col("r.version").alias("record_version"),
        F.col("r.thread_id").alias("record_id"), state.alias("state"),
    )
