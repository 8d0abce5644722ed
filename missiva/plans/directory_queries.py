"""Registered queries of conversations, people, firms, links and scopes beyond the basic ones, with independent SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from missiva.functions import names
from missiva.operators import archive, directory, links, matters, threads
from missiva.plans.queries import QUERIES, SQL, TODAY, query  # noqa: F401
from missiva.plans.views import table, view

# Mail with copies in a second folder, messages without an id (the third of a conversation, and some first ones), and references.
LONE = "(pos = 0 and ordinal % 19 = 0)"
COPIES = f"""(select ordinal, o_custkey, blk, pos, case when pos = 3 or {LONE} then '' else message_id end as message_id, folder, sender, sent_day from mail_full
  union all select ordinal + 100000000, o_custkey, blk, pos, message_id, 'Archive', 'copy ' || sender, sent_day from mail_full where pos in (1, 2) and ordinal % 3 = 0)"""
NODE = "case when message_id = '' then 'path::' || ordinal else message_id end"


def copies(spark, sf):
    mail = view(spark, sf, "mail_full").withColumn("subject", F.lit("s"))
    blank = (F.col("pos") == 3) | ((F.col("pos") == 0) & (F.col("ordinal") % 19 == 0))
    kept = mail.withColumn("message_id", F.when(blank, "").otherwise(F.col("message_id")))
    again = mail.where("pos in (1, 2) and ordinal % 3 = 0").withColumns({"ordinal": F.col("ordinal") + 100000000, "folder": F.lit("Archive"), "sender": F.concat(F.lit("copy "), "sender")})
    # replies name their parent, which may be no row, or only among the references
    refs = F.when(F.col("pos") > 1, F.array("reply_to", F.lit(""), F.lit(None)))
    both = kept.unionByName(again).withColumn("refs", refs).withColumn("reply_to", F.when(F.col("pos") > 1, None).otherwise(F.col("reply_to")))
    return both.withColumn("has_attach", F.col("ordinal") % 5 == 0)


@query(f"""
select substr(sha1(string_agg(node, chr(10) order by node)), 1, 16) as thread_id, arg_min(node, sent_day || lpad(cast(ordinal as string), 12, '0')) as root_id, count(*) as n, min(sent_day) as start_day, max(sent_day) as end_day,
  count(distinct sender) as people, max(places) as places, bool_or(att) as has_attach
from (select {NODE} as node, min(ordinal) as ordinal, min(sent_day) as sent_day, arg_min(sender, ordinal) as sender, count(*) as places, bool_or(ordinal % 5 = 0) as att, any_value(o_custkey) as c, any_value(blk) as b,
    bool_or({LONE}) as lone from {COPIES} x group by 1) m group by c, b, lone""")
def thread_members(spark, sf):
    members = threads.thread_members(threads.link_threads(copies(spark, sf), "refs"))
    rolled = threads.member_rollup(members, F.max(F.size("locations")).alias("places"))
    return threads.newest_first(rolled.select("thread_id", "root_id", "n", "start_day", "end_day", F.size("participants").alias("people"), "places", "has_attach"))


@query(f"""select ordinal, message_id from (select *, row_number() over (partition by {NODE} order by ordinal) as k from {COPIES} x) y where k = 1 or message_id = ''""")
def first_of_id(spark, sf):
    return threads.first_of_id(copies(spark, sf)).select("ordinal", "message_id")


def cluster_votes(spark, sf):
    letter = F.substring(F.lit("abcdefghijklmnopqrstuvwxyz"), (F.col("c_custkey") % 26 + 1).cast("int"), F.lit(1))
    key = F.concat(F.repeat(letter, F.lit(8)), F.when(F.col("c_custkey") % 3 == 0, "x1").when(F.col("c_custkey") % 3 == 1, "").otherwise("y"))
    return table(spark, sf, "customer").select("c_custkey", key.alias("key"), F.initcap(key).alias("name")).groupBy("key", "name").agg(F.count("*").alias("messages"))


@query("""
select key, arg_min(key, lpad(cast(100000000 - n as string), 9, '0') || key) over (partition by k) as canonical,
  arg_min(upper(substr(key, 1, 1)) || substr(key, 2), lpad(cast(100000000 - n as string), 9, '0') || lpad(cast(100 - length(key) as string), 3, '0') || key) over (partition by k) as name
from (select c_custkey % 26 as k, repeat(chr(cast(97 + c_custkey % 26 as integer)), 8) || case c_custkey % 3 when 0 then 'x1' when 1 then '' else 'y' end as key, count(*) as n from customer group by 1, 2) x""")
def company_clusters(spark, sf):
    return directory.company_clusters(cluster_votes(spark, sf))


@query("""
select key, domain from (select *, max(n) over (partition by key) as most from (
  select 'alpha' || c_custkey % 7 as key, 'firm' || c_custkey % 5 || '.example' as domain, count(*) as n from customer group by 1, 2) x) y where n = most""")
def company_owners(spark, sf):
    people = table(spark, sf, "customer").select(F.concat(F.lit("u@firm"), F.col("c_custkey") % 5, F.lit(".example")).alias("email"), F.concat(F.lit("Alpha "), F.col("c_custkey") % 7, F.lit(" (SG) Pte. Ltd.")).alias("company"))
    return directory.company_owners(people)


@query("""select 'k' || c_custkey as from_key, 'k' || (c_custkey + 1) as to_key from customer where c_custkey % 10 not in (0, 1, 7, 8) and c_custkey % 5 <> 4""")
def valid_merges(spark, sf):
    k = F.col("c_custkey") % 10
    to = F.when(k == 0, F.concat(F.lit("k"), "c_custkey")).when(k == 1, " ").when(k == 7, F.concat(F.lit("k"), F.col("c_custkey") + 1)).when(k == 8, F.concat(F.lit("k"), F.col("c_custkey") - 1)).otherwise(F.concat(F.lit("k"), F.col("c_custkey") + 1))
    rows = table(spark, sf, "customer").where("c_custkey % 5 <> 4").select(F.concat(F.lit("k"), "c_custkey").alias("from_key"), to.alias("to_key"))
    return directory.valid_merges(rows)


@query("""
select 'u' || c_custkey || '@x.example' as email, case when c_custkey % 4 = 0 then 'main' else 'k' || c_custkey % 4 end as key from customer
union all select 'alias' || c_custkey || '@x.example', case when c_custkey % 4 = 0 then 'main' else 'k' || c_custkey % 4 end from customer where c_custkey % 2 = 0""")
def key_map(spark, sf):
    address = lambda p: F.concat(F.lit(p), "c_custkey", F.lit("@x.example"))
    people = table(spark, sf, "customer").select(address("u").alias("email"), F.when(F.col("c_custkey") % 2 == 0, F.array(address("alias"))).alias("aliases"), F.concat(F.lit("k"), F.col("c_custkey") % 4).alias("company_key"))
    return directory.key_map(people, spark.createDataFrame([("k0", "mid"), ("mid", "main")], "from_key string, to_key string"))


@query("""
select case c_custkey % 6 when 0 then 'For Acme' when 1 then 'Pte Ltd' when 2 then 'ACME BUILD' when 3 then 'Acme [x]' when 4 then 'ACME' else 'Acme Build' end as name, 'C' || c_custkey // 2 as code, 'check name' as issue from customer where c_custkey % 6 < 4
union all select case c_custkey % 6 when 0 then 'For Acme' when 1 then 'Pte Ltd' when 2 then 'ACME BUILD' when 3 then 'Acme [x]' when 4 then 'ACME' else 'Acme Build' end, 'C' || c_custkey // 2, 'duplicate code'
from (select *, row_number() over (partition by c_custkey // 2 order by c_custkey) as k from customer) x where k > 1""")
def firm_issues(spark, sf):
    k = F.col("c_custkey") % 6
    name = F.when(k == 0, "For Acme").when(k == 1, "Pte Ltd").when(k == 2, "ACME BUILD").when(k == 3, "Acme [x]").when(k == 4, "ACME").otherwise("Acme Build")
    return directory.firm_issues(table(spark, sf, "customer").select(name.alias("name"), F.concat(F.lit("C"), F.floor(F.col("c_custkey") / 2)).alias("code"), F.col("c_custkey").alias("ordinal")))


@query("""
select c_custkey, case c_custkey % 6 when 0 then 'Dan Goh' when 1 then '' when 2 then '' when 3 then 'Ann' when 4 then '' else 'Albert Tang' end as name, case c_custkey % 3 when 0 then 'Dan Goh' else '' end as from_local,
  case c_custkey % 3 when 0 then c_custkey % 6 = 0 else null end as own, case when c_custkey % 2 = 0 then 'Contoso Asia' else '' end as firm from customer""")
def signature_people(spark, sf):
    k = F.col("c_custkey") % 6
    raw = F.when(k == 0, "'Dan Goh | Initech SG'").when(k == 1, "projects").when(k == 2, "VENDOR. COM").when(k == 3, "Ann (Branch)").when(k == 4, "a@b.example").otherwise("Albert Tang")
    email = F.when(k % 3 == 0, "dan.goh@contoso.example").when(k % 3 == 1, "sales@contoso.example").otherwise("u12@contoso.example")
    signed = F.when(k == 0, "Goh Dan").otherwise("Mei Lin Wong")
    lines = F.array(F.lit("Contoso Asia Holdings Private Limited Company"), F.lit("see www.contoso.example"), F.when(F.col("c_custkey") % 2 == 0, "Contoso Asia ·").otherwise("Other Firm"), F.lit("Contoso Singapore Asia"))
    lines = F.when(F.col("c_custkey") % 2 == 0, lines).otherwise(F.array(F.lit("Other Firm")))
    return table(spark, sf, "customer").select(
        "c_custkey", names.person_name(raw, email).alias("name"), names.name_from_local(email).alias("from_local"), F.when(k % 3 == 0, names.own_signature(F.lit("Dan Goh"), email, signed)).alias("own"),
        names.company_of_domain(lines, F.lit("contoso.example")).alias("firm"),
    )


@query("""
select l_orderkey, l_linenumber, case l_linenumber % 3 when 0 then 'https://www.dropbox.com/s/f' || l_partkey || '?x=' || l_suppkey || '&dl=1' when 1 then 'https://drive.google.com/uc?export=download&id=file-000000' || l_partkey else null end as direct,
  case l_linenumber % 3 when 0 then 'Link returned not-found / expired — the file may have been removed or the URL changed.' when 1 then '' else 'Couldn''t fetch this link (network or browser error) — it''ll be retried next time.' end as note from lineitem""")
def direct_links(spark, sf):
    k = F.col("l_linenumber") % 3
    url = F.when(k == 0, F.concat(F.lit("https://www.dropbox.com/s/f"), "l_partkey", F.lit("?dl=0&x="), "l_suppkey")).when(k == 1, F.concat(F.lit("https://drive.google.com/file/d/file-000000"), "l_partkey", F.lit("/view"))).otherwise("https://we.tl/x")
    provider, status = F.when(k == 0, "Dropbox").when(k == 1, "Google Drive").otherwise("WeTransfer"), F.when(k == 0, "dead").when(k == 1, "downloaded").otherwise("error")
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", links.direct_url(url, provider).alias("direct"), links.status_note(status, provider, url).alias("note"))


@query("""
select (select count(*) from mail_v) as scanned, count(distinct message_id) as with_links, (select string_agg(provider || '=' || n, '|' order by provider || '=' || n) from (select provider, count(*) as n from link_v group by 1) y) as by_provider, count(*) as links from link_v""")
def harvest_summary(spark, sf):
    return links.harvest_summary(view(spark, sf, "mail_v"), view(spark, sf, "link_v"))


@query("""
select sum(case status when 'downloaded' then 1 else 0 end) as downloaded, sum(case status when 'dead' then 1 else 0 end) as dead, 0 as needs_auth, 0 as failed, sum(case status when 'pending' then 1 else 0 end) as remaining,
  'partial: ' || sum(case status when 'pending' then 1 else 0 end) || ' remaining' as phase from link_v""")
def fetch_summary(spark, sf):
    return links.fetch_summary(view(spark, sf, "link_v"))


@query("""select ordinal, ordinal % 30 = 6 or ordinal % 10 = 6 as credit, ordinal % 3 = 0 as paid from mail_v where ordinal % 30 = 6 or ordinal % 10 = 6 or ordinal % 3 = 0""")
def phrase_rules(spark, sf):
    said = F.concat(F.when((F.col("ordinal") % 30 == 6) | (F.col("ordinal") % 10 == 6), "a credit note, please").otherwise("credit for noted"), F.when(F.col("ordinal") % 3 == 0, "请付款谢谢").otherwise("款付"))
    items = view(spark, sf, "mail_v").select("ordinal", said.alias("text"), "sender", F.lit(None).cast("string").alias("project"))
    rules = spark.createDataFrame([("keyword", "Credit Note", "credit", 1), ("keyword", "付款", "paid", 2)], "kind string, match string, category string, ordinal long")
    each = [matters.match_rules(items, rules.where(F.col("category") == c), "ordinal").select("ordinal", F.lit(True).alias(c)) for c in ("credit", "paid")]
    return each[0].join(each[1], "ordinal", "full").select("ordinal", F.coalesce("credit", F.lit(False)).alias("credit"), F.coalesce("paid", F.lit(False)).alias("paid"))
