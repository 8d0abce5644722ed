"""Registered queries of streams, stores and histories, with independent SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from missiva.operators import components, history, threads
from missiva.plans.queries import QUERIES, SQL, query  # noqa: F401
from missiva.plans.views import table, view
from missiva.session import materialize, scratch_dir
from missiva.sources import mailbox, tables
from missiva.streaming import ingest, staleness

ROCKS = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def fresh_folder(spark: SparkSession, tag: str) -> str:
    return f"{scratch_dir(spark)}/{tag}-{uuid.uuid4().hex}"


@query("""
select folder, pos as validity, count(*) as n, count(distinct ordinal) as keys, sum(size) as size from mail_full group by folder, pos""")
def store_composite_keys(spark, sf):
    """Messages landed twice, taken in by two queries with checkpoints of their own: each (folder, validity, key) once."""
    mail = view(spark, sf, "mail_full").select("folder", F.col("pos").alias("validity"), F.col("ordinal").alias("key"), "size")
    once = ingest.replay(materialize(mail, "landed"), ["folder", "validity", "key"])
    return once.groupBy("folder", "validity").agg(F.count("*").alias("n"), F.count_distinct("key").alias("keys"), F.sum("size").alias("size"))


def line_events(spark: SparkSession, sf: str) -> DataFrame:
    """Messages, files and records made of order lines: a line is a message, the third line also brings a file, records of every other order know its first three lines."""
    lines = table(spark, sf, "lineitem").select(F.col("l_orderkey").cast("string").alias("thread"), "l_orderkey", "l_linenumber", F.col("l_shipdate").cast("date").cast("string").alias("day"))
    none, at = F.lit(None).cast("long"), F.timestamp_seconds(F.col("l_linenumber") * 3600)
    said = lines.select("thread", F.lit("message").alias("kind"), "day", none.alias("n"), none.alias("attach"), at.alias("at"))
    files = lines.where("l_linenumber = 3").select("thread", F.lit("file").alias("kind"), F.lit(None).cast("string").alias("day"), none.alias("n"), none.alias("attach"), at.alias("at"))
    made = lines.where("l_linenumber <= 3 and l_orderkey % 2 = 0").groupBy("thread").agg(F.max("day").alias("day"), F.count("*").alias("n"), F.count_if(F.col("l_linenumber") == 3).alias("attach"))
    return said.unionByName(files).unionByName(made.select("thread", F.lit("record").alias("kind"), "day", "n", "attach", F.timestamp_seconds(F.lit(3 * 3600)).alias("at")))


@query("""
with s as (
  select l_orderkey, count(*) as n, max(cast(cast(l_shipdate as date) as string)) as "end", sum(case when l_linenumber = 3 then 1 else 0 end) as attach,
    sum(case when l_linenumber <= 3 then 1 else 0 end) as old_n, max(case when l_linenumber <= 3 then cast(cast(l_shipdate as date) as string) end) as old_end
  from lineitem group by l_orderkey)
select cast(l_orderkey as varchar) as thread, n, "end", attach from s where l_orderkey % 2 = 0 and old_n > 0 and (n <> old_n or "end" <> old_end)""")
def stale_stream(spark, sf):
    """A stream of events tells of each stale thread once; the last event only moves the watermark past all timers."""
    base = fresh_folder(spark, "stale")
    line_events(spark, sf).write.parquet(f"{base}/events/first")
    beat = spark.createDataFrame([("", "message", None, None, None)], staleness.EVENT.removesuffix(", at timestamp")).withColumn("at", F.lit("2000-01-01").cast("timestamp"))
    beat.write.parquet(f"{base}/events/last")
    before = spark.conf.get(ROCKS[0])
    spark.conf.set(*ROCKS)
    try:
        events = spark.readStream.schema(staleness.EVENT).option("recursiveFileLookup", "true").parquet(f"{base}/events")
        told = staleness.stale_stream(events).writeStream.format("parquet").option("path", f"{base}/told").option("checkpointLocation", f"{base}/checkpoint")
        told.trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(ROCKS[0], before)
    return spark.read.schema(staleness.RESULT).parquet(f"{base}/told")


@query("""
select 'Box' || c_nationkey as folder, c_custkey as key, lower(c_custkey || '@letters.example') as mid, 'Account of ' || c_name as subject,
  'customer' || c_custkey || '@firm.example' as sender, cast(case when c_custkey % 4 = 0 then 1 else 0 end as bigint) as refs from customer""")
def incremental_headers(spark, sf):
    """A letter to every customer, in two deliveries; each run of the stream parses the new ones only."""
    mailbox.register(spark)
    base = fresh_folder(spark, "letters")
    number = F.col("c_custkey").cast("string")
    raw = F.concat(
        F.lit("From: =?utf-8?q?Customer?= <Customer"), number, F.lit("@Firm.example>\r\nTo: us@x.example\r\nMessage-ID: <"), number, F.lit("@Letters.example>\r\nDate: Mon, 01 Jan 2024 10:00:00 +0800\r\n"),
        F.when(F.col("c_custkey") % 4 == 0, F.concat(F.lit("References: <"), number, F.lit("@asked>\r\n"))).otherwise(""), F.lit("Subject: Account of\r\n "), F.col("c_name"), F.lit("\r\n\r\nDear Sir\r\n"),
    )
    letters = table(spark, sf, "customer").select(F.concat(F.lit("Box"), "c_nationkey").alias("folder"), F.lit(1).cast("long").alias("validity"), F.col("c_custkey").cast("long").alias("key"), raw.cast("binary").alias("raw"))
    half = F.col("key") <= table(spark, sf, "customer").agg(F.expr("percentile_approx(c_custkey, 0.5)")).first()[0]
    for delivery in (letters.where(half), letters.where(~half)):
        delivery.write.format("mailbox").mode("append").save(f"{base}/box")
        found = spark.readStream.format("mailbox").schema("folder string, validity long, key long, mid string, subject string, refs array<string>, addrs array<string>").load(f"{base}/box")
        ingest.stream_once(found, ["folder", "validity", "key"], f"{base}/store", f"{base}/checkpoint").awaitTermination()
    parsed = ingest.read_store(spark, f"{base}/store", found.schema)
    return parsed.select("folder", "key", "mid", "subject", F.col("addrs")[0].alias("sender"), F.size("refs").cast("long").alias("refs"))


@query("""
with t as (select *, 'bridge' || o_custkey || '-' || cast(floor(blk / 2) as bigint) as component from mail_v),
logged as (
  select 1 as version, component, o_custkey, blk, count(*) as n, max(sent_day) as last_day from t where sent_day < '1995-01-01' group by component, o_custkey, blk
  union all select 2, component, o_custkey, blk, count(*), max(sent_day) from t where sent_day < '1997-01-01' group by component, o_custkey, blk),
recorded as (select *, row_number() over (partition by component order by version desc, n desc, last_day desc) as k, count(*) over (partition by component) as n_records from logged where version = 1 or o_custkey % 2 = 0),
names as (select component, count(distinct blk || '-' || n) as n_names from logged group by component)
select cur.component, cur.n, cur.last_day, coalesce(n_names, 0) as n_names, coalesce(n_records, 0) as n_records, r.version as record_version,
  case when r.version is null then 'pending' when r.n = cur.n and r.last_day = cur.last_day then 'done' else 'stale' end as state
from (select component, count(*) as n, max(sent_day) as last_day from t group by component) cur
left join recorded r on r.component = cur.component and r.k = 1 left join names on names.component = cur.component""")
def thread_history(spark, sf):
    """Threads of three times: records of the first two are found although threads have grown, and late messages have joined every two."""
    mail = materialize(view(spark, sf, "mail_v").select("ordinal", "o_custkey", "blk", "message_id", "reply_to", "folder", "sender", "sent_day"), "mail")
    edges = mail.select("sent_day", F.col("message_id").alias("src"), F.coalesce("reply_to", "message_id").alias("dst"))
    sides = mail.groupBy("o_custkey", "blk").agg(F.min("message_id").alias("dst"))
    late = sides.select(F.concat(F.lit("bridge"), "o_custkey", F.lit("-"), F.floor(F.col("blk") / 2)).alias("src"), "dst")

    def rollup(labels, until):
        rows = mail.where(F.col("sent_day") < until).join(labels, mail.message_id == labels.node)
        return threads.thread_rollup(rows).select("component", "thread_id", "n", F.col("end_day").alias("last_day"))

    first = components.connected_components(edges.where("sent_day < '1995-01-01'"), together=True)
    second = components.extend_components(first, edges.where("sent_day >= '1995-01-01' and sent_day < '1997-01-01'"))
    now = components.extend_components(second, edges.where("sent_day >= '1997-01-01'").select("src", "dst").unionByName(late))
    one, two = (materialize(rollup(labels, until), "rollup") for labels, until in ((first, "1995-01-01"), (second, "1997-01-01")))
    even = mail.where("o_custkey % 2 = 0").select("message_id").join(second, F.col("message_id") == F.col("node")).select("component").distinct()
    records = one.withColumn("version", F.lit(1)).unionByName(two.join(even, "component", "left_semi").withColumn("version", F.lit(2))).drop("component")
    found = history.threads_with_records(rollup(now, "9999"), records, history.name_log(one, 1).unionByName(history.name_log(two, 2)), now)
    return found.select("component", "n", "last_day", "n_names", "n_records", "record_version", "state")


@query("""
select n_nationkey, n_name, r_name, cast(count(c_custkey) as bigint) as customers from nation join region on r_regionkey = n_regionkey left join customer on c_nationkey = n_nationkey group by n_nationkey, n_name, r_name""")
def versioned_updates(spark, sf):
    """A table rewritten in two changes, each on the version that it finds."""
    root = fresh_folder(spark, "versions")
    tables.write_version(table(spark, sf, "nation").select("n_nationkey", "n_name", "n_regionkey"), root)
    counts = table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("customers"))
    tables.change_version(spark, root, lambda df: df.join(counts, "n_nationkey", "left").fillna(0, ["customers"]))
    regions = table(spark, sf, "region").select(F.col("r_regionkey").alias("n_regionkey"), "r_name")
    tables.change_version(spark, root, lambda df: df.join(regions, "n_regionkey").drop("n_regionkey"))
    return tables.read_version(spark, root).select("n_nationkey", "n_name", "r_name", "customers")
