"""Conversations: linking messages and rolling them up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from missiva.operators.components import connected_components


def node_id(message_id: Column, path: Column) -> Column:
    """The message's id, or its path where it has none: such a message is a node of its own."""
    known = F.coalesce(F.trim(message_id), F.lit("")) != ""
    return F.when(known, message_id).otherwise(F.concat(F.lit("path::"), path.cast("string")))


def link_threads(mail: DataFrame, references: str | None = None, path: str = "ordinal") -> DataFrame:
    """``mail`` with the component of each message, linked by ``reply_to`` and the array ``references``.

    Parents that are not in the corpus join their replies all the same. Messages without an id count
    by their path; null and empty references are none. Messages of a thread that lie beside each other
    in ``mail`` are joined there, the others through shuffles.
    """
    rows = mail.withColumn("node", node_id(F.col("message_id"), F.col(path)))
    parents = F.array("reply_to") if references is None else F.concat(F.array("reply_to"), F.coalesce(references, F.array().cast("array<string>")))
    parents = F.filter(parents, lambda x: F.coalesce(F.trim(x), F.lit("")) != "")
    edges = rows.select(F.col("node").alias("src"), F.explode(F.concat(F.array("node"), parents)).alias("dst"))
    return rows.join(connected_components(edges, together=True), "node").drop("node")


def thread_members(threads: DataFrame, path: str = "ordinal") -> DataFrame:
    """One row per message of a thread: the attributes of its first copy, the places of all copies in order, and whether any copy has attachments."""
    rows = threads.withColumn("node", node_id(F.col("message_id"), F.col(path)))
    first = F.min_by(F.struct("sent_day", "sender", "subject", "ordinal"), "ordinal").alias("first")
    places = F.array_sort(F.collect_set(F.struct("ordinal", "folder"))).alias("locations")
    found = rows.groupBy("component", "node").agg(first, places, F.max(F.coalesce("has_attach", F.lit(False))).alias("has_attach"))
    return found.select("component", F.col("node").alias("message_id"), "first.*", "locations", "has_attach")


def member_rollup(members: DataFrame, *more: Column) -> DataFrame:
    """Per thread of :func:`thread_members`: id of the sorted message ids, root, size, first and last day, participants, attachments, and ``more`` aggregates; undated messages come last."""
    order = F.struct(F.col("sent_day").isNull(), "sent_day", "ordinal")
    # the messages of a thread are scattered by their ids: rows are shuffled, not sets of one
    return members.repartition("component").groupBy("component").agg(
        F.substring(F.sha1(F.array_join(F.array_sort(F.collect_set("message_id")), "\n")), 1, 16).alias("thread_id"), F.min_by("message_id", order).alias("root_id"), F.count("*").alias("n"),
        F.min("sent_day").alias("start_day"), F.max("sent_day").alias("end_day"), F.array_sort(F.collect_set("sender")).alias("participants"), F.max("has_attach").alias("has_attach"),
        *more,
    )


def newest_first(rollup: DataFrame) -> DataFrame:
    """Threads by last day, newest first, undated last."""
    return rollup.orderBy(F.coalesce("end_day", F.lit("")).desc(), "thread_id")


def first_of_id(mail: DataFrame) -> DataFrame:
    """The first row of each message id; rows without an id all stay."""
    known = F.coalesce(F.trim("message_id"), F.lit("")) != ""
    first = Window.partitionBy(node_id(F.col("message_id"), F.col("ordinal"))).orderBy("ordinal")
    return mail.withColumn("__k", F.row_number().over(first)).where(~known | (F.col("__k") == 1)).drop("__k")


def thread_rollup(threads: DataFrame) -> DataFrame:
    """Per thread: size, first and last day, root, participants, folders, and an id made of its sorted message ids. One row per message is expected."""
    return threads.repartition("component").groupBy("component").agg(
        F.count("*").alias("n"), F.min("sent_day").alias("start_day"), F.max("sent_day").alias("end_day"), F.min_by("message_id", F.struct("sent_day", "ordinal")).alias("root_id"),
        F.size(F.collect_set("sender")).cast("long").alias("participants"), F.size(F.collect_set("folder")).cast("long").alias("folders"),
        F.substring(F.sha1(F.array_join(F.array_sort(F.collect_set("message_id")), "\n")), 1, 16).alias("thread_id"),
    )


def thread_summary(rollup: DataFrame) -> DataFrame:
    """Threads, those of several messages, singletons, messages."""
    return rollup.agg(F.count("*").alias("threads"), F.count_if(F.col("n") > 1).alias("multi"), F.count_if(F.col("n") == 1).alias("singletons"), F.sum("n").alias("messages"))


def position_tags(threads: DataFrame, keys: list[str]) -> DataFrame:
    """``tag`` M1..Mn in order of day, undated last, then of arrival."""
    w = Window.partitionBy(*keys).orderBy(F.col("sent_day").asc_nulls_last(), "ordinal")
    return threads.withColumn("tag", F.concat(F.lit("M"), F.row_number().over(w)))
