"""Registered queries of the correspondence operators, with independent SQL.

The SQL takes expected values from columns wherever it can, so that it does not repeat the code that
it checks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from missiva.functions import atoms, deadlines, names, text
from missiva.operators import archive, directory, links, matters, scoring, threads
from missiva.plans.views import KEY_DIGITS, table, view, with_views
from missiva.streaming import ingest

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
TODAY = "1998-06-21"
HOLIDAYS = ("1996-12-25", "1997-12-25", "1998-12-25", "1997-01-01", "1998-01-01")


def query(sql: str | None):
    """Register a function under its name, with SQL over the views."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = with_views(sql)
        return f

    return add


# --- archive -------------------------------------------------------------------------------------


@query("""select coalesce(folder, '(all)') as folder, count(*) as messages, count(distinct message_id) as unique_ids from mail_v group by grouping sets ((folder), ())""")
def index_summary(spark, sf):
    return archive.index_summary(view(spark, sf, "mail_v"))


@query("""select folder, ordinal, size, k as rank from (select *, row_number() over (partition by folder order by size desc, ordinal) as k from mail_v) x where k <= 10""")
def top_n_by_size(spark, sf):
    return archive.top_per_group(view(spark, sf, "mail_v"), ["folder"], [F.desc("size"), F.col("ordinal")], 10).select("folder", "ordinal", "size", "rank")


@query("""select ordinal, folder, size from mail_v where sent_day between '1996-03-01' and '1997-08-31' and size >= 100000""")
def date_size_filter(spark, sf):
    mail = view(spark, sf, "mail_v")
    return mail.where(archive.in_window(F.col("sent_day"), F.col("size"), "1996-03-01", "1997-08-31", 100000)).select("ordinal", "folder", "size")


@query("""select folder, ordinal, k as rank from (select *, row_number() over (partition by folder order by ordinal) as k from mail_v) x where k <= 25""")
def limit_per_folder(spark, sf):
    return archive.top_per_group(view(spark, sf, "mail_v"), ["folder"], [F.col("ordinal")], 25).select("folder", "ordinal", "rank")


@query("""select ordinal, folder from mail_v where ordinal % 3 <> 0""")
def resume_antijoin(spark, sf):
    mail = view(spark, sf, "mail_v")
    return mail.join(mail.where("ordinal % 3 = 0").select("message_id"), "message_id", "left_anti").select("ordinal", "folder")


@query("""
select folder, sum(i) as indexed, sum(d) as on_disk, sum(i * (1 - d)) as n_missing, sum(d * (1 - i)) as n_orphans, sum(i * (1 - d)) + sum(d * (1 - i)) = 0 as ok
from (select folder, case when pos = 0 and ordinal % 11 = 0 then 0 else 1 end as i, case when ordinal % 7 = 0 then 0 else 1 end as d from mail_full) x where i + d > 0 group by folder""")
def reconcile(spark, sf):
    path = F.concat("folder", F.lit("/"), "message_id", F.lit(".eml")).alias("path")
    disk = view(spark, sf, "mail_full").where("ordinal % 7 <> 0").select("folder", path)
    return archive.reconcile(view(spark, sf, "mail_v").select("folder", path), disk).drop("missing", "orphans")


@query("""select o_custkey, message_id, sent_day from (select *, row_number() over (partition by o_custkey order by sent_day desc, ordinal desc) as k from mail_v) x where k = 1""")
def latest_per_key(spark, sf):
    return archive.latest(view(spark, sf, "mail_v").select("o_custkey", "message_id", "sent_day", "ordinal"), ["o_custkey"], "sent_day", "ordinal").drop("ordinal")


@query("""
select o_custkey, ordinal, running from (
  select *, sum(size) over (partition by o_custkey order by sent_day, ordinal rows between unbounded preceding and current row) as running,
    row_number() over (partition by o_custkey order by sent_day, ordinal) as rn from mail_v) x where running <= 500000 or rn = 1""")
def budget_admission(spark, sf):
    return archive.admit(view(spark, sf, "mail_v"), ["o_custkey"], ["sent_day", "ordinal"], "size", 500000).select("o_custkey", "ordinal", "running")


@query("""
select cur.o_custkey, cur.blk, cur.n, cur.last_day, case when old.n is null then 'pending' when old.n = cur.n and old.last_day = cur.last_day then 'done' else 'stale' end as state
from (select o_custkey, blk, count(*) as n, max(sent_day) as last_day from mail_v group by 1, 2) cur
left join (select o_custkey, blk, count(*) as n, max(sent_day) as last_day from mail_v where sent_day < '1998-01-01' group by 1, 2) old on cur.o_custkey = old.o_custkey and cur.blk = old.blk""")
def stale_threads(spark, sf):
    mail = view(spark, sf, "mail_v")
    sign = lambda df: df.groupBy("o_custkey", "blk").agg(F.count("*").alias("n"), F.max("sent_day").alias("last_day"))
    return archive.coverage(sign(mail), sign(mail.where("sent_day < '1998-01-01'")), ["o_custkey", "blk"])


@query("""
select state, count(*) as n from (
  select case when old.n is null then 'pending' when old.n = cur.n and old.last_day = cur.last_day then 'done' else 'stale' end as state
  from (select o_custkey, blk, count(*) as n, max(sent_day) as last_day from mail_v group by 1, 2) cur
  left join (select o_custkey, blk, count(*) as n, max(sent_day) as last_day from mail_v where sent_day < '1998-01-01' group by 1, 2) old on cur.o_custkey = old.o_custkey and cur.blk = old.blk) x group by state""")
def coverage_counts(spark, sf):
    return stale_threads(spark, sf).groupBy("state").agg(F.count("*").alias("n"))


# --- conversations -------------------------------------------------------------------------------

COMPONENT = "least(min(message_id) over (partition by o_custkey, blk), coalesce(min(reply_to) over (partition by o_custkey, blk), min(message_id) over (partition by o_custkey, blk)))"


@query(f"select message_id, {COMPONENT} as component from mail_v")
def thread_components(spark, sf):
    return threads.link_threads(view(spark, sf, "mail_v")).select("message_id", "component")


@query(f"""
select component, count(*) as n, min(sent_day) as start_day, max(sent_day) as end_day, arg_min(message_id, sent_day || lpad(cast(ordinal as string), 12, '0')) as root_id,
  count(distinct sender) as participants, count(distinct folder) as folders, substr(sha1(string_agg(message_id, chr(10) order by message_id)), 1, 16) as thread_id
from (select *, {COMPONENT} as component from mail_v) x group by component""")
def thread_rollup(spark, sf):
    return threads.thread_rollup(threads.link_threads(view(spark, sf, "mail_v")))


@query("""
select count(*) as threads, sum(case when n > 1 then 1 else 0 end) as multi, sum(case when n = 1 then 1 else 0 end) as singletons, sum(n) as messages
from (select count(*) as n from mail_v group by o_custkey, blk) x""")
def thread_summary(spark, sf):
    return threads.thread_summary(threads.thread_rollup(threads.link_threads(view(spark, sf, "mail_v"))))


@query("""select message_id, 'M' || row_number() over (partition by o_custkey, blk order by sent_day, ordinal) as tag from mail_v""")
def message_position_tags(spark, sf):
    return threads.position_tags(view(spark, sf, "mail_v"), ["o_custkey", "blk"]).select("message_id", "tag")


@query("""
select o_custkey, sender, n as messages from (
  select o_custkey, sender, count(*) as n, row_number() over (partition by o_custkey order by count(*) desc, min(ordinal)) as k from mail_v group by 1, 2) x where k = 1""")
def dominant_sender(spark, sf):
    by = view(spark, sf, "mail_v").groupBy("o_custkey", "sender").agg(F.count("*").alias("messages"), F.min("ordinal").alias("first"))
    return archive.top_per_group(by, ["o_custkey"], [F.desc("messages"), F.col("first")], 1).select("o_custkey", "sender", "messages")


# --- links ---------------------------------------------------------------------------------------


@query("""select distinct message_id, url from link_v where (message_id, url) not in (select message_id, url from link_v where l_orderkey % 2 = 0)""")
def link_upsert(spark, sf):
    every = view(spark, sf, "link_v").select("message_id", "url", "l_orderkey")
    return links.new_links(every, every.where("l_orderkey % 2 = 0").select("message_id", "url")).select("message_id", "url")


@query("""
select outcome, count(*) as n from (
  select case when status <> 'pending' then status when max(r) over (partition by url) = 2 then 'downloaded' when max(r) over (partition by url) = 1 then 'dead' else 'pending' end as outcome
  from (select *, case status when 'downloaded' then 2 when 'dead' then 1 else 0 end as r from link_v) x) y group by outcome""")
def url_outcome_reuse(spark, sf):
    return links.reuse_outcomes(view(spark, sf, "link_v")).groupBy("outcome").agg(F.count("*").alias("n"))


@query("""select provider, status, count(*) as n, count(distinct url) as urls from link_v group by provider, status""")
def link_status_rollup(spark, sf):
    return view(spark, sf, "link_v").groupBy("provider", "status").agg(F.count("*").alias("n"), F.count_distinct("url").alias("urls"))


@query("""
select message_id, count(*) as total, sum(case when status = 'downloaded' then 1 else 0 end) as fetched, sum(case when status = 'pending' then 1 else 0 end) as pending from link_v group by message_id""")
def link_state_by_message(spark, sf):
    return links.link_state(view(spark, sf, "link_v"), "message_id")


@query("""
select o_orderkey as thread, count(*) as links from orders join lineitem on l_orderkey = o_orderkey where not (l_linenumber % 4 = 1) group by 1""")
def link_thread_or_join(spark, sf):
    orders, items = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    # a link names its message by id (odd line), by path (even line), by both (every fourth), or, on other odd lines, by neither
    ref = items.withColumn("link_id", F.monotonically_increasing_id())
    k = F.col("l_linenumber") % 4
    ref = items.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate").alias("link_id"),
        F.when(k.isin(0, 3), F.concat(F.lit("m"), "l_orderkey")).alias("message_id"), F.when(k.isin(0, 2), F.concat(F.lit("p"), "l_orderkey")).alias("path"),
    )
    messages = orders.select(F.col("o_orderkey").alias("thread"), F.concat(F.lit("m"), "o_orderkey").alias("message_id"), F.concat(F.lit("p"), "o_orderkey").alias("path"))
    return links.links_of_messages(ref, messages).groupBy("thread").agg(F.count("*").alias("links"))


@query("""
select ordinal, case ordinal % 3 when 0 then 'Box' when 1 then 'Dropbox' else 'Google Drive' end as provider,
  case ordinal % 3 when 0 then 'https://app.box.com/s/' when 1 then 'https://www.dropbox.com/s/' else 'https://drive.google.com/file/' end || ordinal as url from mail_v""")
def detect_links(spark, sf):
    host = F.when(F.col("ordinal") % 3 == 0, "https://app.box.com/s/").when(F.col("ordinal") % 3 == 1, "https://www.dropbox.com/s/").otherwise("https://drive.google.com/file/")
    said = F.concat(F.lit("Files at ("), host, "ordinal", F.lit("), again "), host, "ordinal", F.lit("."))
    return view(spark, sf, "mail_v").select("ordinal", F.explode(atoms.extract_links(said)).alias("x")).select("ordinal", "x.provider", "x.url")


# --- extractors ----------------------------------------------------------------------------------


@query("""select ordinal, 'PO-' || ordinal as refs from mail_v""")
def extract_refs(spark, sf):
    return view(spark, sf, "mail_v").select("ordinal", F.array_join(atoms.extract_refs(F.col("body"), KEY_DIGITS), "|").alias("refs"))


@query("""select ordinal, sent_day as dates from mail_v""")
def extract_dates(spark, sf):
    return view(spark, sf, "mail_v").select("ordinal", F.array_join(atoms.extract_dates(F.col("body")), "|").alias("dates"))


@query("""select o_orderkey as ordinal, 'USD ' || regexp_replace(printf('%.2f', o_totalprice), '\\.?0+$', '') as amounts from orders where o_orderkey in (select ordinal from mail_v)""")
def extract_amounts(spark, sf):
    found = F.transform(atoms.extract_amounts(F.col("body")), lambda x: F.concat(x["currency"], F.lit(" "), x["value"]))
    return view(spark, sf, "mail_v").select("ordinal", F.array_join(found, "|").alias("amounts"))


@query("""select ordinal, (ordinal % 10 + 1) || '%' as percents from mail_v""")
def extract_percents(spark, sf):
    return view(spark, sf, "mail_v").select("ordinal", F.array_join(atoms.extract_percents(F.col("body")), "|").alias("percents"))


@query("""select ordinal, sender as emails from mail_v""")
def extract_emails(spark, sf):
    said = F.concat(F.lit("From "), F.upper("sender"), F.lit(". See "), "sender", F.lit("."))
    return view(spark, sf, "mail_v").select("ordinal", F.array_join(atoms.extract_emails(said), "|").alias("emails"))


@query("""select ordinal, 'within' as kind, ordinal % 30 + 1 as n, 'days' as unit, 'after' as direction, 'now/receipt' as anchor from mail_v""")
def find_deadlines(spark, sf):
    return view(spark, sf, "mail_v").select("ordinal", F.explode(deadlines.find_deadlines(F.col("body"))).alias("x")).select("ordinal", "x.kind", F.col("x.n").cast("long").alias("n"), "x.unit", "x.direction", "x.anchor")


@query("""select ordinal, 'From [EMAIL] [MRN], [DOB], [NRIC], [ID], call +[PHONE] on ' || ordinal as masked from mail_v""")
def pii_mask(spark, sf):
    said = F.concat(F.lit("From "), "sender", F.lit(" MRN: "), F.col("ordinal") + 10000, F.lit(", DOB 1980-01-02, S1234567D, member id AB1234, call +65 6123 4567 on "), "ordinal")
    return view(spark, sf, "mail_v").select("ordinal", text.mask_identifiers(said).alias("masked"))


@query("""select ordinal, case ordinal % 4 when 0 then 'personal-data' when 1 then 'privileged|without-prejudice' when 2 then '' else 'confidential' end as classes from mail_v""")
def sensitivity(spark, sf):
    k = F.col("ordinal") % 4
    said = F.when(k == 0, "The PATIENT called").when(k == 1, "Privileged and without prejudice").when(k == 2, "outpatient morphine").otherwise("这是保密的")
    return view(spark, sf, "mail_v").select("ordinal", F.array_join(text.sensitivity(said), "|").alias("classes"))


@query("""select ordinal, k, case k when 1 then 'Please confirm PO-' || ordinal || ' by ' || sent_day || ' for USD ' || size else 'Reply within ' || (ordinal % 30 + 1) || ' days' end as sentence,
  'deadline,request' as cues, true as has_deadline from mail_v, (select 1 as k union all select 2) two""")
def obligation_candidates(spark, sf):
    found = F.posexplode(text.obligation_candidates(F.col("body"))).alias("k", "x")
    rows = view(spark, sf, "mail_v").select("ordinal", found)
    return rows.select("ordinal", (F.col("k") + 1).alias("k"), F.col("x.text").alias("sentence"), F.array_join("x.cues", ",").alias("cues"), F.col("x.has_deadline").alias("has_deadline"))


@query("""
select prefix, shape, example, n from (
  select 'PO' as prefix, 'A-9' as shape, 'PO-' || min(ordinal) as example, count(*) as n from mail_v
  union all select 'USD', 'A 9', 'USD ' || arg_min(size, ordinal), count(*) from mail_v) x""")
def ref_patterns_topk(spark, sf):
    found = view(spark, sf, "mail_v").select("ordinal", F.explode(atoms.candidate_refs(F.col("body"))).alias("token"))
    by = found.groupBy(F.upper(F.regexp_extract("token", "^[A-Za-z]+", 0)).alias("prefix"), atoms.shape(F.col("token")).alias("shape")).agg(F.count("*").alias("n"), F.min_by("token", "ordinal").alias("example"))
    return by.orderBy(F.desc("n"), "prefix", "shape").limit(20)


# --- deadlines -----------------------------------------------------------------------------------


def _resolved(spark, sf, unit: str, holidays=()):
    n, anchor = (F.col("ordinal") % 30 + 1).cast("int"), F.col("sent_day").cast("date")
    return view(spark, sf, "mail_v").select("ordinal", F.date_format(deadlines.resolve(n, F.lit(unit), F.lit("after"), anchor, holidays), "yyyy-MM-dd").alias("due"))


@query("""select ordinal, cast(cast(sent_day as date) + cast(ordinal % 30 + 1 as integer) as string) as due from mail_v""")
def resolve_deadline_days(spark, sf):
    return _resolved(spark, sf, "days")


@query("""select ordinal, cast(cast(sent_day as date) + cast(7 * (ordinal % 30 + 1) as integer) as string) as due from mail_v""")
def resolve_deadline_weeks(spark, sf):
    return _resolved(spark, sf, "weeks")


@query("""select ordinal, strftime(cast(sent_day as date) + to_months(cast(ordinal % 30 + 1 as integer)), '%Y-%m-%d') as due from mail_v""")
def resolve_deadline_months(spark, sf):
    return _resolved(spark, sf, "months")


@query(f"""
with calendar as (select cast(d as date) as d, row_number() over (order by d) as no from range(date '1990-01-01', date '2002-01-01', interval 1 day) t(d)
  where isodow(d) < 6 and cast(cast(d as date) as string) not in {HOLIDAYS}),
x as (select ordinal, cast(sent_day as date) as day, cast(ordinal % 30 + 1 as integer) as n from mail_v),
base as (select x.ordinal, x.n, c.no from x asof join calendar c on x.day >= c.d)
select base.ordinal, cast(c.d as string) as due from base join calendar c on c.no = base.no + base.n""")
def resolve_deadline_business(spark, sf):
    return _resolved(spark, sf, "businessdays", HOLIDAYS)


@query("""
select ordinal, cast(day + case ordinal % 4 when 0 then 0 when 1 then 1 when 2 then (4 - w + 7) % 7 else (4 - w + 7) % 7 + 7 end as string) as due
from (select ordinal, cast(sent_day as date) as day, cast(isodow(cast(sent_day as date)) - 1 as integer) as w from mail_v) x""")
def resolve_colloquial(spark, sf):
    k = F.col("ordinal") % 4
    said = F.when(k == 0, "by EOD").when(k == 1, "Tomorrow please").when(k == 2, "by Friday").otherwise("next Fri")
    return view(spark, sf, "mail_v").select("ordinal", F.date_format(deadlines.resolve_colloquial(said, F.col("sent_day").cast("date")), "yyyy-MM-dd").alias("due"))


@query("""select ordinal, case ordinal % 5 when 0 then 'weekly' when 1 then 'monthly' when 2 then 'quarterly' when 3 then 'annual' else '' end as cadence from mail_v""")
def recurrence(spark, sf):
    k = F.col("ordinal") % 5
    said = F.when(k == 0, "Send it fortnightly").when(k == 1, "每月 report").when(k == 2, "Every quarter").when(k == 3, "pay YEARLY").otherwise("once")
    return view(spark, sf, "mail_v").select("ordinal", deadlines.recurrence(said).alias("cadence"))


# --- matters -------------------------------------------------------------------------------------

OPEN = f"(select *, date_diff('day', date '{TODAY}', cast(due_canonical as date)) as days_left from action_v where coalesce(is_mine, true) and status <> 'done')"
PRIORITY = "case priority when 'high' then 0 when 'low' then 2 else 1 end"


@query(f"""select thread_id, l_linenumber, due_canonical, days_left, days_left < 0 as overdue, priority,
  row_number() over (partition by thread_id order by days_left, {PRIORITY}, l_linenumber, due_canonical) as rank from {OPEN} x where true""")
def need_you_rank(spark, sf):
    rows = view(spark, sf, "action_v").withColumn("tie", F.struct("l_linenumber", "due_canonical"))
    return matters.need_you(rows, TODAY, ["thread_id"], "tie").select("thread_id", "l_linenumber", "due_canonical", "days_left", "overdue", "priority", "rank")


@query(f"""select thread_id, l_linenumber, days_left, case when days_left < 0 then 100 else greatest(4, cast(round_even((30 - least(days_left, 30)) / 30 * 100, 0) as integer)) end as gauge from {OPEN} x""")
def urgency_gauge(spark, sf):
    return matters.open_obligations(view(spark, sf, "action_v"), TODAY).select("thread_id", "l_linenumber", "days_left", matters.gauge(F.col("days_left")).alias("gauge"))


@query(f"""select count(*) as tracked, sum(case when days_left < 0 then 1 else 0 end) as overdue, sum(case when days_left between 0 and 7 then 1 else 0 end) as due_soon, 0 as undated from {OPEN} x""")
def todo_counters(spark, sf):
    return matters.counters(matters.open_obligations(view(spark, sf, "action_v"), TODAY))


@query(f"""select thread_id, min(due_canonical) as due, min(days_left) as days_left from {OPEN} x group by thread_id""")
def soonest_due(spark, sf):
    return matters.open_obligations(view(spark, sf, "action_v"), TODAY).groupBy("thread_id").agg(F.min("due_canonical").alias("due"), F.min("days_left").alias("days_left"))


@query("""select ordinal, 3 + case when ordinal % 30 + 1 = 7 or ordinal % 10 + 1 = 7 then 2 else 0 end + 1 as score from mail_v""")
def keyword_scores(spark, sf):
    words = spark.createDataFrame([("confirm", 3), ("7", 2), ("retention", 1), ("absent", 9)], "term string, weight long")
    mail = view(spark, sf, "mail_v").withColumn("said", F.concat(F.lit("Please confirm. Retention "), (F.col("ordinal") % 10 + 1), F.lit("% in "), (F.col("ordinal") % 30 + 1), F.lit(" days")))
    return matters.keyword_scores(mail, F.broadcast(words), "ordinal", "said")


@query("""
select ordinal, case when project = 'tower 2' then 'building' when o_custkey % 40 = 7 then 'firm' else 'payments' end as category,
  case when project = 'tower 2' then 3 when o_custkey % 40 = 7 then 2 else 1 end as rule
from (select *, 'tower ' || ordinal % 5 as project from mail_v) x""")
def rule_match(spark, sf):
    rules = spark.createDataFrame([("keyword", "confirm", "payments", 1), ("sender", "@firm7.", "firm", 2), ("project", "tower 2", "building", 3), ("keyword", "conf", "never", 4)], "kind string, match string, category string, ordinal int")
    mail = view(spark, sf, "mail_v").select("ordinal", "sender", F.col("body").alias("text"), F.concat(F.lit(" Tower   "), F.col("ordinal") % 5).alias("project"))
    return matters.match_rules(mail.withColumnRenamed("ordinal", "key"), rules, "key").withColumnRenamed("key", "ordinal")


@query(f"""select priority, status, thread_id, l_linenumber, rank from (
  select *, row_number() over (partition by priority, status order by days_left, thread_id, l_linenumber, due_canonical) as rank from {OPEN} x) y where rank <= 40""")
def matters_sorted(spark, sf):
    rows = matters.open_obligations(view(spark, sf, "action_v"), TODAY)
    order = [F.col("days_left").asc_nulls_last(), F.col("thread_id"), F.col("l_linenumber"), F.col("due_canonical")]
    return archive.top_per_group(rows, ["priority", "status"], order, 40).select("priority", "status", "thread_id", "l_linenumber", "rank")


@query(f"""select coalesce(status, '(all)') as status, coalesce(priority, '(all)') as priority, count(*) as n, min(days_left) as soonest from {OPEN} x group by rollup (status, priority)""")
def matters_rollup(spark, sf):
    rows = matters.open_obligations(view(spark, sf, "action_v"), TODAY)
    return rows.rollup("status", "priority").agg(F.count("*").alias("n"), F.min("days_left").alias("soonest")).na.fill("(all)", ["status", "priority"])


# --- scoring -------------------------------------------------------------------------------------


def _facts(spark, sf):
    """Atoms of each body, and an output that lost one class on every fourth row and made one up on every fifth."""
    plain = F.transform(F.col("a.amounts"), lambda x: F.concat(x["currency"], F.lit(" "), x["value"]))
    k = F.col("ordinal") % 4
    lose = lambda c, i: F.when(k == i, F.array().cast("array<string>")).otherwise(c)
    rows = view(spark, sf, "mail_v").select("ordinal", atoms.extract_atoms(F.col("body"), KEY_DIGITS).alias("a")).select("ordinal", F.col("a.refs").alias("refs"), F.col("a.dates").alias("dates"), plain.alias("amounts"))
    invented = F.when(F.col("ordinal") % 5 == 0, F.array(F.lit("ZZ-1"))).otherwise(F.array().cast("array<string>"))
    return rows.select(
        "ordinal", F.struct("refs", "dates", "amounts").alias("source"),
        F.struct(F.concat(lose(F.col("refs"), 0), invented).alias("refs"), lose(F.col("dates"), 1).alias("dates"), lose(F.col("amounts"), 2).alias("amounts")).alias("output"),
    )


@query("""
select kind, count(*) as required, sum(case when ordinal % 4 = k then 0 else 1 end) as covered, sum(case when ordinal % 4 = k then 1 else 0 end) as missed,
  round_even(cast(sum(case when ordinal % 4 = k then 0 else 1 end) as double) / count(*), 4) as recall
from mail_v, (select 'refs' as kind, 0 as k union all select 'dates', 1 union all select 'amounts', 2) c group by kind""")
def floor_recall(spark, sf):
    return scoring.floor_recall(_facts(spark, sf))


@query("""select count(*) as gold_threads, sum(case when ordinal % 4 = 3 then 1 else 0 end) as zero_miss, round_even(cast(sum(case when ordinal % 4 = 3 then 1 else 0 end) as double) / count(*), 4) as rate from mail_v""")
def gold_zero_miss(spark, sf):
    return scoring.zero_miss(_facts(spark, sf).withColumnRenamed("source", "gold"))


@query("""
select found_by, kind, count(*) as n from (
  select 'A' as found_by, case ordinal % 4 when 0 then 'refs' when 1 then 'dates' else 'amounts' end as kind from mail_v where ordinal % 4 < 3
  union all select 'B', 'refs' from mail_v where ordinal % 5 = 0) x group by 1, 2""")
def ab_compare(spark, sf):
    return scoring.disagreements(_facts(spark, sf), "ordinal").groupBy("found_by", "kind").agg(F.count("*").alias("n"))


@query("""
select l_orderkey as item, case when l_orderkey % 2 = 0 then 'A' else 'B' end as found_by, sum(y) as yes, count(*) as roles,
  case when 2 * sum(y) > count(*) then case when l_orderkey % 2 = 0 then 'B_missed' else 'A_gap' end else case when l_orderkey % 2 = 0 then 'A_false_positive' else 'B_hallucination' end end as verdict
from (select *, case when l_quantity > 20 and l_tax < 0.05 then 1 else 0 end as y from lineitem) x group by l_orderkey""")
def panel_vote(spark, sf):
    votes = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("item"), F.when(F.col("l_orderkey") % 2 == 0, "A").otherwise("B").alias("found_by"), (F.col("l_quantity") > 20).alias("present"), (F.col("l_tax") < 0.05).alias("is_real")
    )
    return scoring.panel_vote(votes)


# --- directory -----------------------------------------------------------------------------------


@query("""select sender, count(distinct message_id) as messages, min(sent_day) as first_day, max(sent_day) as last_day, arg_max(message_id, sent_day || lpad(cast(ordinal as string), 12, '0')) as newest from mail_v group by sender""")
def sender_rollup(spark, sf):
    return directory.sender_rollup(view(spark, sf, "mail_v"))


@query("""select email, replace(lower(p_name), ' ', '') as key, 'firm' || (c_custkey % 40) || '.example' as domain from person_v""")
def company_keys(spark, sf):
    return view(spark, sf, "person_v").select("email", names.company_key(F.col("company")).alias("key"), names.domain(F.col("email")).alias("domain"))


@query("""
select domain, key, votes from (select *, row_number() over (partition by domain order by votes desc, length(key) desc, key) as k from (
  select 'firm' || (c_custkey % 40) || '.example' as domain, replace(lower(p_name), ' ', '') as key, count(*) as votes from person_v group by 1, 2) x) y where k = 1""")
def firm_consensus(spark, sf):
    return directory.firm_consensus(view(spark, sf, "person_v"))


@query("""
with k as (select distinct replace(lower(p_name), ' ', '') || case when p_partkey % 7 = 0 then 'x' else '' end as key from part)
select a.key as a, b.key as b from k a join k b on substr(a.key, 1, 4) = substr(b.key, 1, 4) and a.key < b.key where levenshtein(a.key, b.key) between 1 and 2 and length(a.key) >= 6 and length(b.key) >= 6""")
def near_duplicate_firms(spark, sf):
    name = F.concat("p_name", F.when(F.col("p_partkey") % 7 == 0, "x").otherwise(""), F.lit(" Pte Ltd"))
    return directory.near_keys(table(spark, sf, "part").select(names.company_key(name).alias("key")))


@query("""select c_custkey as from_key, c_custkey - c_custkey % 16 as to_key from customer where c_custkey % 16 <> 0""")
def merge_chain(spark, sf):
    merges = table(spark, sf, "customer").where("c_custkey % 16 <> 0").select(F.col("c_custkey").alias("from_key"), (F.col("c_custkey") - 1).alias("to_key"))
    return directory.resolve_chains(merges, rounds=4)


@query("""
select project, sum(n) as threads, string_agg(category, '|' order by n desc, category) as categories from (
  select p_brand as project, p_type as category, count(*) as n from part group by 1, 2) x group by project""")
def project_index(spark, sf):
    return directory.project_index(table(spark, sf, "part").select(F.col("p_brand").alias("project"), F.col("p_type").alias("category")))


@query("""
select p_brand as project, s_nationkey as firm, count(distinct l_suppkey) as heads from lineitem join part on p_partkey = l_partkey join supplier on s_suppkey = l_suppkey group by 1, 2""")
def project_firms(spark, sf):
    pairs = table(spark, sf, "lineitem").select("l_partkey", "l_suppkey").distinct()
    rows = pairs.join(table(spark, sf, "part").select("p_partkey", "p_brand"), F.col("p_partkey") == F.col("l_partkey")).join(table(spark, sf, "supplier"), F.col("s_suppkey") == F.col("l_suppkey"))
    return rows.groupBy(F.col("p_brand").alias("project"), F.col("s_nationkey").alias("firm")).agg(F.count_distinct("l_suppkey").alias("heads"))


@query("""
select p_partkey, code || case when k > 1 then cast(k as string) else '' end as unique_code from (select *, row_number() over (partition by code order by p_partkey) as k from (
  select p_partkey, upper(substr(split_part(p_name, ' ', 1), 1, 1) || substr(split_part(p_name, ' ', 2), 1, 1)) as code from part) x) y""")
def unique_codes(spark, sf):
    firms = table(spark, sf, "part").select("p_partkey", names.company_code(F.concat("p_name", F.lit(" Pte Ltd"))).alias("code"))
    return directory.unique_codes(firms, order="p_partkey").select("p_partkey", "unique_code")


@query("""
select 'user' || c_custkey || '@firm' || (c_custkey * 2) || '.example' as email, case when c_custkey % 7 = 0 then 'own' || c_custkey else coalesce(p_name, '') end as firm from customer left join part on p_partkey = c_custkey * 2""")
def participant_firms(spark, sf):
    address = F.concat(F.lit("user"), "c_custkey", F.lit("@firm"), F.col("c_custkey") * 2, F.lit(".example"))
    people = table(spark, sf, "customer").select("c_custkey", address.alias("email"))
    own = people.where("c_custkey % 7 = 0").select("email", F.concat(F.lit("own"), "c_custkey").alias("company_key"), F.lit("").alias("domain"))
    firms = table(spark, sf, "part").select(F.lit("info").alias("email"), F.col("p_name").alias("company_key"), F.concat(F.lit("firm"), "p_partkey", F.lit(".example")).alias("domain"))
    return directory.participant_firms(people.select("email"), own.unionAll(firms))


@query("""select event_type, sum(value) as tokens, greatest(0, 100000 - sum(value)) as token_left from events group by event_type""")
def usage_totals(spark, sf):
    by = table(spark, sf, "events").groupBy("event_type").agg(F.sum("value").alias("tokens"))
    return by.withColumn("token_left", F.greatest(F.lit(0), 100000 - F.col("tokens")))


# --- text and streams ----------------------------------------------------------------------------


@query("""
select page_id, trim(regexp_replace(regexp_replace(regexp_replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(
  regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\\b.*?</script\\s*>|<style\\b.*?</style\\s*>|<!--.*?-->', ' ', 'g'),
    '(?i)<br\\s*/?>|</(p|div|tr|li|h[1-6]|table|ul|ol|article|section|nav|head|title)\\s*>', chr(10), 'g'), '<[^>]*>', ' ', 'g'),
  '&copy;', '©'), '&middot;', '·'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&apos;', ''''), '&amp;', '&'),
  '[ \\t\\v\\f\\r]+', ' ', 'g'), ' ?\\n ?', chr(10), 'g'), '\\n{2,}', chr(10), 'g'), ' ' || chr(10)) as body from pages""")
def html_to_text(spark, sf):
    return table(spark, sf, "pages").select("page_id", text.html_to_text(F.col("html")).alias("body"))


@query("""select event_type, count(*) as n, count(distinct event_id) as ids from events group by event_type""")
def stream_exactly_once(spark, sf):
    return ingest.replay(table(spark, sf, "events").select("event_id", "event_type", "ts"), "event_id").groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("event_id").alias("ids"))
