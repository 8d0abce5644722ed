"""Registered queries of evaluation against gold, link outcomes, firms and projects, with independent SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from missiva.functions.names import firm_code
from missiva.operators import book, links, scoring
from missiva.plans.queries import QUERIES, SQL, query  # noqa: F401
from missiva.plans.views import KEY_DIGITS, table, view


# --- evaluation ----------------------------------------------------------------------------------


def _evaluated(spark, sf):
    """Outputs in free words that lose a class on some rows (an earlier output of each thread is worse still), and gold with a class of its own."""
    mail = view(spark, sf, "mail_v").withColumnRenamed("ordinal", "thread_id")
    k, none = F.col("thread_id") % 4, F.array().cast("array<string>")
    told = lambda i, c: F.when(k == i, none).otherwise(F.array(c))
    sum_ = F.regexp_extract("body", r"for (USD [0-9.]+)\.", 1)
    facts = F.create_map(
        F.lit("refs"), told(0, F.concat(F.lit("see PO-"), "thread_id")), F.lit("dates"), told(1, F.concat(F.lit("on "), F.date_format("sent_day", "d MMMM yyyy"))),
        F.lit("amounts"), told(2, sum_), F.lit("actions"), F.array(F.concat(F.lit(" Reply "), k.cast("string"))),
    )
    outputs = mail.select("thread_id", F.lit("2").alias("ts"), facts.alias("facts")).unionAll(mail.select("thread_id", F.lit("1"), F.lit(None).cast("map<string,array<string>>")))
    atoms = F.create_map(F.lit("refs"), F.array(F.concat(F.lit("PO-"), "thread_id")), F.lit("actions"), F.when(k == 3, F.array(F.lit("reply 3"), F.lit("pay"))).otherwise(F.array(F.concat(F.lit("reply "), k.cast("string")))))
    gold = mail.select("thread_id", (F.col("thread_id") % 3 == 0).alias("confirmed"), atoms.alias("atoms"))
    return scoring.evaluate(outputs, mail.select("thread_id", F.col("body").alias("text")), gold, KEY_DIGITS)


@query("""
select side, kind, required, covered, round_even(cast(covered as double) / required, 4) as recall from (
  select 'floor' as side, kind, count(*) as required, sum(case when ordinal % 4 = k then 0 else 1 end) as covered
  from mail_v, (select 'refs' as kind, 0 as k union all select 'dates', 1 union all select 'amounts', 2) c group by kind
  union all select 'gold', 'refs', count(*), sum(case when ordinal % 4 = 0 then 0 else 1 end) from mail_v where ordinal % 3 = 0
  union all select 'gold', 'actions', sum(case when ordinal % 4 = 3 then 2 else 1 end), count(*) from mail_v where ordinal % 3 = 0) x""")
def evaluation_recall(spark, sf):
    return scoring.evaluation_recall(_evaluated(spark, sf))


@query("""
select count(*) as comprehended, sum(case when ordinal % 4 < 3 then 1 else 0 end) as hard_misses, sum(case when ordinal % 3 = 0 then 1 else 0 end) as gold_threads,
  sum(case when ordinal % 3 = 0 and ordinal % 4 in (1, 2) then 1 else 0 end) as zero_miss,
  round_even(cast(sum(case when ordinal % 3 = 0 and ordinal % 4 in (1, 2) then 1 else 0 end) as double) / sum(case when ordinal % 3 = 0 then 1 else 0 end), 4) as no_miss_rate from mail_v""")
def evaluation_summary(spark, sf):
    return scoring.evaluation_summary(_evaluated(spark, sf))


@query("""
select ordinal as thread_id, case ordinal % 4 when 0 then 'refs' when 1 then 'dates' else 'amounts' end as kind,
  case ordinal % 4 when 0 then 'PO-' || ordinal when 1 then sent_day else 'usd' end as missed from mail_v where ordinal % 4 < 3""")
def floor_details(spark, sf):
    missed = F.array_join("missed", "|")
    return scoring.floor_details(_evaluated(spark, sf)).withColumn("missed", F.when(F.col("kind") == "amounts", F.lower(F.substring(missed, 1, 3))).otherwise(missed))


# --- links ---------------------------------------------------------------------------------------

CATALOGUE = """
select 'm' || l_orderkey as message_id, 'https://files' || (l_suppkey % 5) || '.example/p' || l_partkey as url, case l_suppkey % 5 when 0 then 'Box' when 1 then 'Dropbox' else 'Google Drive' end as provider,
  case l_suppkey % 7 when 0 then 'downloaded' when 1 then 'dead' when 2 then 'needs-auth' when 3 then 'needs-confirm' else 'pending' end as status,
  case when l_suppkey % 7 = 0 and l_linenumber > 1 then 'f' || l_orderkey || '-' || l_linenumber end as file, case when l_suppkey % 7 = 3 then l_orderkey * 1000000 else null end as size,
  l_quantity > 40 as confirmed, l_orderkey * 10 + l_linenumber as ordinal, 'in/' || l_orderkey || '.eml' as path, l_orderkey, l_linenumber
from {lineitem}"""
CAT = CATALOGUE.format(lineitem="lineitem")
TOLD = f"""
cat as ({CAT}),
known as (select url, max(file is not null) as f, arg_max(file, ordinal) filter (file is not null) as known_file, max(status = 'needs-confirm') as l, arg_max(size, ordinal) filter (status = 'needs-confirm') as known_size, max(case when status = 'dead' then 1 else 0 end) as d, max(case when status = 'needs-auth' then 1 else 0 end) as a from cat group by url),
told as (select cat.*, case when f then 'downloaded' when confirmed then null when l then 'needs-confirm' when d = 1 then 'dead' when a = 1 then 'needs-auth' end as told, known_file, known_size from cat join known using (url) where status = 'pending')"""


def catalogue(spark, sf):
    return spark.sql(CATALOGUE, lineitem=table(spark, sf, "lineitem"))


@query(f"""
with {TOLD}
select message_id, url, told as status, case when told = 'downloaded' then known_file end as file, case when told = 'needs-confirm' then known_size end as size from told where told is not null""")
def settled_links(spark, sf):
    return links.fetch_plan(catalogue(spark, sf))[0].drop("note")


@query(f"""with {TOLD} select url, arg_max(provider, ordinal) as provider, bool_or(confirmed) as confirmed, count(*) as links from told where told is null group by url""")
def links_to_fetch(spark, sf):
    return links.fetch_plan(catalogue(spark, sf))[1]


@query(f"""
with cat as ({CAT})
select status, url, provider from (select *, row_number() over (partition by status order by ordinal) as k from cat where status in ('needs-auth', 'dead')) x where k <= 50""")
def link_triage(spark, sf):
    return links.triage(catalogue(spark, sf))


@query(f"""with cat as ({CAT}) select status, count(*) as n, string_agg(distinct provider, '|' order by provider) as providers from cat group by status""")
def link_statuses(spark, sf):
    return links.status_counts(catalogue(spark, sf)).withColumn("providers", F.array_join("providers", "|"))


@query(f"""with cat as ({CAT}) select message_id, url, provider, round_even(size / 1073741824.0, 2) as gb from cat where status = 'needs-confirm'""")
def links_to_confirm(spark, sf):
    return links.to_confirm(catalogue(spark, sf))


@query(f"""
with cat as ({CAT})
select o_custkey || '-' || blk as thread_id, count(*) as total, count(*) filter (status = 'downloaded') as fetched, count(*) filter (status in ('pending', 'needs-auth', 'needs-confirm')) as pending
from cat join mail_v on ordinal_of = l_orderkey group by 1""".replace("cat join mail_v on ordinal_of", "cat join (select ordinal as ordinal_of, o_custkey, blk from mail_v) m on ordinal_of"))
def thread_link_states(spark, sf):
    rows = catalogue(spark, sf).withColumns({"message_id": F.when(F.col("l_linenumber") % 2 == 0, F.col("message_id")), "path": F.replace("path", F.lit("/"), F.lit("\\"))})
    members = view(spark, sf, "mail_v").select(F.concat("o_custkey", F.lit("-"), "blk").alias("thread_id"), F.concat(F.lit("m"), "ordinal").alias("message_id"), F.concat(F.lit("in/"), "ordinal", F.lit(".eml")).alias("path"))
    return links.thread_links(rows, members)


# --- firms and projects --------------------------------------------------------------------------


def _people(spark, sf):
    k = F.col("c_custkey") % 40
    return view(spark, sf, "person_v").select(
        "c_custkey", "email", "name", F.when(k == 20, "").otherwise(F.concat(F.lit("k"), k)).alias("company_key"), F.when(k % 2 == 0, F.col("company")).otherwise("").alias("company"), F.concat(F.lit("firm"), k, F.lit(".example")).alias("domain"),
    )


def _merges(spark):
    return spark.createDataFrame([("k38", "k39"), ("k39", "k1"), ("k7", "k8"), ("k8", "k7")], "from_key string, to_key string")


PEOPLE = """
ppl as (select c_custkey, email, name, case when k in (38, 39) then 'k1' when k = 20 then '' else 'k' || k end as key, case when k % 2 = 0 then company else '' end as company, 'firm' || k || '.example' as domain
  from (select *, c_custkey % 40 as k from person_v) z)"""


@query(f"""
with {PEOPLE},
best as (select key, company, row_number() over (partition by key order by count(*) desc, length(company) desc, company) as r from ppl where company <> '' group by key, company),
on_ as (select key, string_agg(distinct o_orderpriority, '|' order by o_orderpriority) as projects from ppl join orders on o_custkey = c_custkey group by key)
select p.key, case when p.key in ('k3', 'k4') then 'Name ' || p.key else coalesce(b.company, min(p.domain)) end as name, b.company is null and p.key not in ('k3', 'k4') as unverified, count(*) as count, min(p.domain) as domain,
  case when p.key = 'k5' then 'Builds' else '' end as description, coalesce(o.projects, '') as projects
from ppl p left join best b on b.key = p.key and r = 1 left join on_ o on o.key = p.key where p.key <> '' group by p.key, b.company, o.projects""")
def firm_book(spark, sf):
    people = _people(spark, sf)
    preferences = spark.createDataFrame([("k3", "name", "Name k3"), ("k4", "name", "Name k4"), ("k5", "description", "Builds"), ("k6", "name", " ")], "key string, kind string, value string")
    took = table(spark, sf, "orders").join(people.withColumnRenamed("c_custkey", "o_custkey"), "o_custkey").select(F.col("o_orderpriority").alias("project"), "email")
    return book.firm_book(people, preferences, _merges(spark), took).withColumn("projects", F.array_join("projects", "|")).drop("code")


@query(f"""with {PEOPLE} select key, row_number() over (partition by key order by lower(name), email) as place, email, name from ppl""")
def firm_people(spark, sf):
    return book.firm_people(_people(spark, sf), _merges(spark))


@query("""
with w as (select p_partkey, list_filter(regexp_split_to_array(p_name, '[^A-Za-z0-9]+'), lambda x: x <> '') as ws from part)
select p_partkey, upper(substr(case when len(ws) >= 2 then array_to_string(list_transform(ws, lambda x: x[1]), '') else substr(array_to_string(ws, ''), 1, 4) end, 1, 6)) as code from w""")
def firm_codes(spark, sf):
    name = F.concat(F.lit("The "), "p_name", F.lit(" (Asia) and Co Pte. Ltd"))
    return table(spark, sf, "part").select("p_partkey", firm_code(name).alias("code"))


@query("""
with f as (select 'acmeb' || chr(97 + cast(k // 26 as integer)) || chr(97 + cast(k % 26 as integer)) || case when k % 2 = 0 then 'x' else 'yz' end as key from (select distinct c_custkey % 60 as k from customer) c)
select x.key as a, y.key as b from f x join f y on x.key < y.key and levenshtein(x.key, y.key) <= 2""")
def look_alike_firms(spark, sf):
    k = F.col("c_custkey") % 60
    name = F.concat(F.lit("Acme-B"), F.char(97 + F.floor(k / 26)), F.char(97 + k % 26), F.when(k % 2 == 0, "x").otherwise("yz"), F.lit(" Pte Ltd"))
    return book.look_alikes(table(spark, sf, "customer").select(name.alias("name"), F.lit(False).alias("unverified")).distinct())[0]


RECORDS = "select l_orderkey * 10 + l_linenumber as thread_id, case when l_linenumber % 3 = 0 then upper(mode) else mode || case when l_linenumber % 4 = 1 then '  Yard' else ' Yard' end end as project, case when l_returnflag = 'N' then '' else l_returnflag end as category from (select *, case l_partkey % 5 when 0 then 'Mail' when 1 then 'Reg Air' when 2 then 'Ship' when 3 then 'Rail' else 'Air' end as mode from {lineitem}) m"


def _records(spark, sf):
    merges = spark.createDataFrame([("mail", "mail yard"), ("reg air", "air yard")], "from_key string, to_key string")
    return spark.sql(RECORDS, lineitem=table(spark, sf, "lineitem")), merges


PROJECTS = f"""
r as (select thread_id, trim(project) as spelling, category, lower(regexp_replace(trim(project), '\\s+', ' ', 'g')) as own from ({RECORDS.format(lineitem="lineitem")}) x),
k as (select *, case own when 'mail' then 'mail yard' when 'reg air' then 'air yard' else own end as key from r),
s as (select key, spelling, row_number() over (partition by key order by max(case when key = own then 1 else 0 end) desc, count(*) desc, length(spelling), spelling desc) as place from k group by key, spelling),
c as (select key, string_agg(category, '|' order by n desc, category) as categories from (select key, category, count(*) as n from k where category <> '' group by 1, 2) x group by key),
p as (select k.key, s.spelling as name, count(*) as count, coalesce(c.categories, '') as categories from k join s on s.key = k.key and place = 1 left join c on c.key = k.key group by 1, 2, c.categories)"""


@query(f"with {PROJECTS} select * from p")
def project_book(spark, sf):
    return book.project_book(*_records(spark, sf)).withColumn("categories", F.array_join("categories", "|"))


@query(f"""
with {PROJECTS}, w as (select distinct own as asked, case own when 'mail' then 'mail yard' when 'reg air' then 'air yard' else own end as key from r)
select asked, p.key, name, count from w join p on p.key = w.key""")
def project_look_up(spark, sf):
    records, merges = _records(spark, sf)
    asked = records.select(book.project_key(F.col("project")).alias("key")).unionAll(records.select(F.lit("unknown")))
    return book.look_up(book.project_book(records, merges), asked, "key", merges).drop("categories")


@query("""select doc_id, substr(sha1(doc_id || '|' || trim(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9]+', ' ', 'g'))), 1, 12) as key from documents""")
def item_keys(spark, sf):
    return table(spark, sf, "documents").select("doc_id", book.item_key(F.col("doc_id"), F.col("text")).alias("key"))


@query("""
select 'lang' as kind, trim(lang) as value, count(*) as n from documents where trim(coalesce(lang, '')) <> '' group by 1, 2
union all select 'source', trim(source), count(*) from documents where trim(coalesce(source, '')) <> '' group by 1, 2""")
def document_chips(spark, sf):
    return book.chips(table(spark, sf, "documents"), ["lang", "source"])


@query("""select ordinal, folder, case folder when 'Sent' then 1 else 2 end as turn from mail_v where folder in ('Sent', 'INBOX')""")
def copies_to_take(spark, sf):
    return book.copies_to_take(view(spark, sf, "mail_v"), ["Sent", "INBOX"]).select("ordinal", "folder", "turn")
