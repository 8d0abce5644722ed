"""Registered queries of the record assembly. Answers of a model are made from order lines; the SQL takes what must come out from their columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from missiva.functions import text
from missiva.operators import matters, records
from missiva.plans.queries import QUERIES, SQL, query  # noqa: F401
from missiva.plans.views import KEY_DIGITS, table
from missiva.session import spread

L = "l_orderkey, l_linenumber"


def lines(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.floor("l_quantity").cast("long").alias("quantity"), F.substring(F.col("l_shipdate").cast("date").cast("string"), 1, 10).alias("day"))


def say(*parts):
    """Text of literals and columns (names in braces)."""
    return F.concat(*(F.col(p[1:-1]).cast("string") if p.startswith("{") and p.endswith("}") and ":" not in p and " " not in p else F.lit(p) for p in parts))


@query(f"""select {L}, case l_orderkey % 5 when 3 then 1 when 4 then 0 else 2 end as n, case l_orderkey % 5 when 4 then null else 'PO-' || l_partkey end as first_ref, l_orderkey % 5 <> 4 as parsed from lineitem""")
def model_json(spark, sf):
    whole = say('{"refs": ["PO-', "{l_partkey}", '", "INV-', "{l_suppkey}", '"], "note": "a, \\"b\\" {c}"}')
    cut = say('{"refs": ["PO-', "{l_partkey}", '", "INV-', "{l_suppkey}")
    k = F.col("l_orderkey") % 5
    raw = F.when(k == 0, whole).when(k == 1, F.concat(F.lit("```json\n"), whole, F.lit("\n```"))).when(k == 2, F.concat(F.lit("Here it is: "), whole, F.lit(" Done."))).when(k == 3, cut).otherwise("no object at all")
    got = records.parse_objects(lines(spark, sf).withColumn("raw", raw), "raw")
    refs = F.from_json("json", "struct<refs:array<string>>")["refs"]
    return got.select("l_orderkey", "l_linenumber", F.greatest(F.size(refs), F.lit(0)).alias("n"), F.try_element_at(refs, F.lit(1)).alias("first_ref"), F.col("json").isNotNull().alias("parsed"))


LEDGER = ("Prose of ", "{l_orderkey}", "\n<<<LEDGER>>>\n")


def with_ledger(spark, sf):
    items = say('[{"id": "A', "{l_linenumber}", '", "matter": "Outstanding drawing DWG-', "{l_partkey}", ' revision", "status": "open"}, {"id": "B", "matter": "closed thing", "status": "done"}]')
    boxed = F.when(F.col("l_orderkey") % 3 == 0, items).when(F.col("l_orderkey") % 3 == 1, F.concat(F.lit('{"open_items": '), items, F.lit("}"))).otherwise(F.concat(F.lit("as follows: "), items))
    return lines(spark, sf).withColumn("said", F.when(F.col("l_orderkey") % 7 == 0, say("Only prose of ", "{l_orderkey}")).otherwise(F.concat(say(*LEDGER), boxed, F.lit("\n<<<END>>>"))))


@query(f"""select {L}, case when l_orderkey % 7 = 0 then 'Only prose of ' else 'Prose of ' end || l_orderkey as prose, case when l_orderkey % 7 = 0 then 0 else 2 end as n,
  case when l_orderkey % 7 = 0 then null else 'A' || l_linenumber end as first_id from lineitem""")
def ledger_items(spark, sf):
    items = F.col("items")
    return with_ledger(spark, sf).withColumn("items", records.ledger_items(F.col("said"))).select("l_orderkey", "l_linenumber", records.split_ledger(F.col("said"))["prose"].alias("prose"), F.size(items).alias("n"), F.try_element_at(items, F.lit(1))["id"].alias("first_id"))


@query(f"""select {L}, case when l_orderkey % 7 = 0 or l_linenumber % 2 = 0 then null else 'Outstanding drawing DWG-' || l_partkey || ' revision' end as orphan from lineitem""")
def unreconciled_items(spark, sf):
    acts = F.when(F.col("l_linenumber") % 2 == 0, F.array(F.struct(say("Send DWG-", "{l_partkey}").alias("action"), F.lit("").alias("about"), F.lit("").alias("quote"), F.array().cast("array<string>").alias("refs")))).otherwise(F.from_json(F.lit("[]"), "array<struct<action:string,about:string,quote:string,refs:array<string>>>"))
    rows = with_ledger(spark, sf).withColumn("acts", acts)
    return rows.select("l_orderkey", "l_linenumber", F.try_element_at(records.unreconciled(records.ledger_items(F.col("said")), records.haystack(F.col("acts")), digits=KEY_DIGITS), F.lit(1)).alias("orphan"))


@query(f"""select {L}, 'Tower ' || l_suppkey as project, 'PO-' || l_partkey as refs, '' || l_partkey || '.00' as amounts, 5 as sources, 1 as contacts from lineitem""")
def registrar_facts(spark, sf):
    answer = say(
        '{"project": [{"value": " Tower ', "{l_suppkey}", '", "cite": "M1"}, {"value": "Annex", "cite": "M2"}], "facts": [{"field": "Ref", "value": "PO-', "{l_partkey}", '", "cite": "M1"}, {"field": "ref", "value": "PO-', "{l_partkey}",
        '", "cite": "M2"}, {"field": "amount", "value": "', "{l_partkey}", '.00"}, {"field": "colour", "value": "red"}, {"field": "date", "value": " "}], "contacts": [{"name": " Ann ", "cite": "M3"}, {"phone": "1"}]}',
    )
    f = F.col("f")
    return lines(spark, sf).withColumn("answer", answer).withColumn("f", records.registrar_facts(F.col("answer"))).select("l_orderkey", "l_linenumber", f["project"].alias("project"), F.array_join(f["refs"], "|").alias("refs"), F.array_join(f["amounts"], "|").alias("amounts"), F.size(f["sources"]).alias("sources"), F.size(f["contacts"]).alias("contacts"))


@query(f"""select {L}, case when l_partkey % 2 = 0 then 'PO-' || l_partkey || '|Acme Ltd' else 'PO-' || l_partkey end as kept, case when l_partkey % 2 = 0 then 'INV-0' else 'Acme Ltd|INV-0' end as dropped,
  case when l_partkey >= 100 then 'USD ' || l_partkey || ',000' end as amount from lineitem""")
def fact_grounding(spark, sf):
    source = F.concat(say("We refer to  PO-", "{l_partkey}", ". Pay $", "{l_partkey}", "000 now; acmeland ltd"), F.when(F.col("l_partkey") % 2 == 0, " for Acme\nLTD").otherwise(""))
    rows = lines(spark, sf).withColumn("source", source).withColumn("refs", F.array(say("PO-", "{l_partkey}", " — the order"), say("PO-", "{l_partkey}"), F.lit("Acme Ltd"), F.lit("INV-0")))
    rows = rows.withColumn("amounts", F.array(F.when(F.col("l_partkey") >= 100, say("USD ", "{l_partkey}", ",000")).otherwise("USD 9,999,999")))
    got, money = records.grounded(F.col("refs"), F.col("source")), records.grounded(F.col("amounts"), F.col("source"), numeric=True)
    return rows.select("l_orderkey", "l_linenumber", F.array_join(got["kept"], "|").alias("kept"), F.array_join(got["dropped"], "|").alias("dropped"), F.try_element_at(money["kept"], F.lit(1)).alias("amount"))


@query(f"""select {L}, 'PO-' || (l_partkey + 1) as refs, case when l_linenumber % 2 = 0 then '' else 'USD ' || l_suppkey || '.00' end as amounts from lineitem""")
def floor_backfill(spark, sf):
    rows = lines(spark, sf).withColumn("known", F.array(say("PO-", "{l_partkey}"))).withColumn("floor", F.array(say("PO-", "{l_partkey}"), F.concat(F.lit("PO-"), F.col("l_partkey") + 1)))
    known = F.when(F.col("l_linenumber") % 2 == 0, F.array(say("$", "{l_suppkey}", "00"))).otherwise(F.array(F.lit("x")))
    return rows.select("l_orderkey", "l_linenumber", F.array_join(records.backfill(F.col("known"), F.col("floor")), "|").alias("refs"), F.array_join(records.backfill(known, F.array(say("USD ", "{l_suppkey}", ".00")), amounts=True), "|").alias("amounts"))


DUE = """case l_linenumber % 7 when 0 then cast(cast(l_shipdate as date) as string) when 1 then cast(cast(l_shipdate as date) + 14 as string) when 2 then '' when 3 then '1997-03-09'
  when 4 then cast(year(cast(l_shipdate as date)) as string) || '-03-14' when 5 then cast(cast(l_shipdate as date) + 1 as string) else '' end"""


@query(f"""select {L}, 'Send PO-' || l_partkey as action, {DUE} as due_canonical, l_linenumber % 7 = 2 as due_pending,
  case l_linenumber % 7 when 2 then 'Net-term — confirm invoice date' when 3 then 'event-anchored (verify the anchor date)' when 4 then 'year inferred from message date' when 5 then 'resolved vs message date' else '' end as due_basis,
  case when l_linenumber % 7 = 2 then 'high' else 'normal' end as priority, case when l_suppkey % 2 = 0 then 'inbound' else 'outbound' end as direction, l_suppkey % 2 = 0 as is_mine,
  case when l_orderkey % 2 = 0 then 'done' else 'open' end as status, 'M1' as source, l_partkey % 3 = 0 as quote_unverified, 'review' as confidence from lineitem""")
def action_records(spark, sf):
    due = F.when(F.col("k") == 0, say("by ", "{day}")).when(F.col("k") == 1, "within 14 days").when(F.col("k") == 2, "Net-30").when(F.col("k") == 3, "7 days after the trial").when(F.col("k") == 4, "by 14 March").when(F.col("k") == 5, "tomorrow").otherwise("soon")
    rows = lines(spark, sf).withColumn("k", F.col("l_linenumber") % 7)
    one = {
        "action": say(" Send PO-", "{l_partkey}", " "), "owner": F.when(F.col("l_suppkey") % 2 == 0, "ann@x.com").otherwise("joann@x.com"), "counterparty": F.when(F.col("l_suppkey") % 2 == 0, "Bob").otherwise("the Contractor, Bob"),
        "due_raw": due, "status": F.when(F.col("l_orderkey") % 2 == 0, "Done").otherwise("wondering"), "confidence": F.lit("High"), "source": F.lit("[M1][M9]"),
        "quote": F.when(F.col("l_partkey") % 3 == 0, "never said").otherwise(say("trial  is on||po-", "{l_partkey}")),
    }
    answer = F.concat(F.lit('{"actions": ['), F.to_json(F.struct(*(v.alias(n) for n, v in one.items()))), F.lit(', {"action": " "}]}'))
    rows = rows.withColumn("actions", F.from_json(answer, f"struct<actions:array<{records.ACTION}>>")["actions"]).withColumn("dates", F.create_map(F.lit("M1"), "day", F.lit("M2"), F.lit("1990-01-01")))
    rows = rows.withColumns({"operator": F.lit("ann@x.com; the Contractor"), "comprehension": F.lit("The trial is on 2 Mar 1997.\nNothing else."), "source_text": say("we need PO-", "{l_partkey}", " soon")})
    got = records.clean_actions(rows.select("l_orderkey", "l_linenumber", "actions", "dates", "operator", "comprehension", "source_text"))
    return got.select("l_orderkey", "l_linenumber", "action", "due_canonical", "due_pending", "due_basis", "priority", "direction", "is_mine", "status", F.array_join("source", ",").alias("source"), "quote_unverified", "confidence")


@query(f"""select {L}, case when l_linenumber % 2 = 0 then null else 'Kindly return the signed bond for PO-' || l_partkey end as missed, 'Sign-off is a precondition for PO-' || l_partkey as implied,
  cast(cast(l_shipdate as date) as string) as due_canonical, 'implied-floor' as due_basis, 'Team to review the minutes' as soft from lineitem""")
def missed_duties(spark, sf):
    said = say("Kindly return the signed bond for PO-", "{l_partkey}", ". Sign-off is a precondition for PO-", "{l_partkey}", ". Team to review the minutes. Meeting held on ", "{day}", ". Thanks for the update")
    acts = F.array(F.struct(F.when(F.col("l_linenumber") % 2 == 0, say("Return bond PO-", "{l_partkey}")).otherwise("Nothing").alias("action"), F.lit("").alias("about"), F.lit("").alias("quote"), F.array().cast("array<string>").alias("refs")))
    rows = spread(lines(spark, sf), "l_orderkey", "l_linenumber").withColumn("said", said).withColumn("hay", records.haystack(acts)).withColumn("cued", text.cued_sentences(F.col("said")))
    rows = rows.withColumn("found", text.obligation_candidates(F.col("said"), F.col("cued")))
    rows = rows.withColumn("implied", records.implied_action(F.element_at(text.implied_candidates(F.col("said"), F.col("cued")), 1)["text"]))
    missed = records.uncovered(F.col("found"), F.col("hay"), digits=KEY_DIGITS)
    soft = F.transform(text.soft_candidates(F.col("said"), F.col("found"), F.col("cued")), lambda x: x["text"])
    return rows.select("l_orderkey", "l_linenumber", F.try_element_at(F.filter(missed, lambda m: F.startswith(m, F.lit("Kindly"))), F.lit(1)).alias("missed"), F.col("implied.action").alias("implied"), "implied.due_canonical", "implied.due_basis", F.array_join(soft, "|").alias("soft"))


TAXONOMY = {"Commercial": ("Claim", "Invoice"), "Technical": ("Drawing", "RFI")}


@query(f"""select {L}, case when l_linenumber % 4 = 0 then 'Technical' else 'Commercial' end as domain, case l_linenumber % 4 when 0 then 'RFI' when 1 then 'Claim' when 2 then 'Invoice' else 'Odd' end as category,
  case when l_linenumber % 4 = 0 then 'small' else 'full' end as council, case l_linenumber % 4 when 0 then 'unanimous' when 1 then 'split-resolved' when 2 then 'majority' else 'asked' end as consensus from lineitem""")
def council_consensus(spark, sf):
    k = F.col("l_linenumber") % 4
    vote = lambda d, c, s, q: F.struct(F.lit(d).alias("domain"), c.alias("category"), s.alias("confidence"), q.alias("dispute"))
    small = F.when(k == 0, vote("Technical", F.lit("RFI"), F.lit(0.9), F.lit(False))).otherwise(vote("Commercial", F.lit("Invoice"), F.when(k == 1, 0.5).otherwise(0.9), k == 2))
    full = vote("Commercial", F.when(k == 3, "Odd").otherwise("Invoice"), F.lit(0.8), F.lit(False))
    said = F.when(k == 1, "This claim stands").otherwise("the claimant Costa")
    small = F.when(k == 3, vote("Technical", F.lit("Invoice"), F.lit(0.9), F.lit(False))).otherwise(small)
    got = records.classify(small, full, said, TAXONOMY, [(("claim", "cost"), "Claim")])
    return lines(spark, sf).select("l_orderkey", "l_linenumber", got["domain"].alias("domain"), got["category"].alias("category"), got["council"].alias("council"), got["consensus"].alias("consensus"))


@query(f"""select {L}, l_linenumber % 4 <> 0 as needs_review, case l_linenumber % 4 when 0 then 'x — y' when 1 then 'x — y|input truncated' when 2 then 'x — y|2 item(s) open' else 'x — y' end as issues from lineitem""")
def review_gate(spark, sf):
    k = F.col("l_linenumber") % 4
    issue = records.issue_text(F.struct(F.lit("x").alias("target"), F.lit("").alias("type"), F.lit(" y ").alias("detail"), F.lit(None).cast("string").alias("evidence")))
    got = records.review_gate(F.lit(True), [F.when(k != 3, True)], k == 1, {"{n} item(s) open": F.when(k == 2, F.array(F.lit("a"), F.lit("b")))}, F.array(issue))
    return lines(spark, sf).select("l_orderkey", "l_linenumber", got["needs_review"].alias("needs_review"), F.array_join(got["issues"], "|").alias("issues"))


@query("""select l_orderkey, max(l_linenumber) as attempt, not bool_or(l_quantity > 20) as flagged from lineitem group by l_orderkey""")
def last_attempt(spark, sf):
    return records.last_attempt(lines(spark, sf).withColumn("passed", F.col("quantity") > 20).withColumnRenamed("l_linenumber", "attempt"), ["l_orderkey"]).select("l_orderkey", "attempt", "flagged")


@query("""select l_orderkey, string_agg(case when l_linenumber = lo then 'line ' || l_linenumber || chr(10) || 'CURRENT STATE: x' else 'line ' || l_linenumber end, chr(10) || chr(10) order by l_linenumber)
  || chr(10) || chr(10) || '<<<LEDGER>>>' || chr(10) || '[' || max(l_linenumber) || ']' || chr(10) || '<<<END>>>' as comprehension from (select *, min(l_linenumber) over (partition by l_orderkey) as lo from lineitem) x group by l_orderkey""")
def stitched_chunks(spark, sf):
    said = say("line ", "{l_linenumber}", "\nCURRENT STATE: x\n<<<LEDGER>>>[", "{l_linenumber}", "]<<<END>>>")
    return records.stitch_chunks(lines(spark, sf).withColumn("said", said), ["l_orderkey"], "l_linenumber", "said")


@query(f"""select {L}, 'Phase: Design' as tags, '[{{"text":"PO-' || l_partkey || '","cues":["soft"]}}]' as sheet from lineitem""")
def facet_tags(spark, sf):
    given = F.array(F.lit("phase: DESIGN"), F.lit("Phase: design"), F.lit("Phase: unknown"), F.lit("no colon"), F.lit(None).cast("string"))
    sheet = records.candidate_sheet(F.array(F.struct(say("PO-", "{l_partkey}").alias("text"), F.array(F.lit("soft")).alias("cues"))))
    return lines(spark, sf).select("l_orderkey", "l_linenumber", F.array_join(records.facet_tags(given, {"Phase": ("Design", "Build")}), "|").alias("tags"), sheet.alias("sheet"))


@query(f"""select {L}, case when l_quantity >= 20 then 20 + length('[… attachment truncated for the AI; the floor reads it in full …]') + 1 else cast(floor(l_quantity) as int) end + length('head') + length('[attachment: a.pdf]') + 3 as n,
  l_quantity >= 20 as was_cut from lineitem""")
def capped_messages(spark, sf):
    said = F.concat(F.lit("head\n\n[attachment: a.pdf]\n"), F.repeat(F.lit("x"), F.when(F.col("quantity") >= 20, 50).otherwise(F.col("quantity")).cast("int")))
    got = records.cap_message(said, 200, 20)
    return lines(spark, sf).select("l_orderkey", "l_linenumber", F.char_length(got).alias("n"), F.contains(got, F.lit("attachment truncated")).alias("was_cut"))


@query("""select l_orderkey, term, cast(max(w) as int) as weight from (
  select l_orderkey, 'po-' || l_partkey as term, 3 as w from lineitem union all select l_orderkey, 'tower ' || l_suppkey, 3 from lineitem union all select l_orderkey, 'claim', 2 from lineitem
  union all select l_orderkey, 'retention', 1 from lineitem union all select l_orderkey, 'release', 1 from lineitem) x group by all""")
def item_signals(spark, sf):
    items = lines(spark, sf).select("l_orderkey", F.array(say("PO-", "{l_partkey}")).alias("refs"), say(" Tower ", "{l_suppkey}").alias("project"), F.lit("Claim").alias("category"), F.lit("the").alias("domain"), F.array(F.lit("")).alias("parties"), F.lit("Please release the retention").alias("said"))
    found = items.select("l_orderkey", F.explode(matters.item_signals(F.col("refs"), F.col("project"), F.col("category"), F.col("domain"), F.col("parties"), F.col("said"))).alias("x"))
    return found.groupBy("l_orderkey", "x.term").agg(F.max("x.weight").alias("weight"))


@query("""select term, sum(w) as weight from (select 'po-' || l_partkey as term, 3 as w from lineitem where floor(l_quantity) > 25 union all select 'retention', 1 from lineitem where floor(l_quantity) > 25) x group by term""")
def learned_keywords(spark, sf):
    none = F.array().cast("array<string>")
    items = lines(spark, sf).where("quantity > 25")
    signals = items.select(matters.item_signals(F.array(say("PO-", "{l_partkey}")), F.lit(None).cast("string"), F.lit(""), F.lit(""), none, F.lit("the retention")).alias("signals"))
    return matters.learn_keywords(signals, "signals")
