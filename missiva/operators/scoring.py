"""Recall of extracted facts against the source and against gold, comparison of two extractors, panel votes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from missiva.functions.atoms import REFERENCE_DIGITS, extract_amounts, extract_dates, extract_emails, extract_refs
from missiva.operators.archive import latest
from missiva.session import materialize

CLASSES = ("refs", "dates", "amounts")


def recall(covered: Column, required: Column) -> Column:
    """Share to four places, half to even; null without any required."""
    return F.when(required > 0, F.bround(covered / required, 4))


def floor_recall(rows: DataFrame, source: str = "source", output: str = "output") -> DataFrame:
    """Per class: required, covered and missed atoms. Both columns are structs of string arrays."""
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("kind"), F.array_distinct(F.col(f"{source}.{c}")).alias("need"), F.col(f"{output}.{c}").alias("have")) for c in CLASSES))).alias("x")
    got = rows.select(each).select("x.kind", F.size("x.need").alias("required"), F.size(F.array_intersect("x.need", "x.have")).alias("covered"))
    out = got.groupBy("kind").agg(F.sum("required").alias("required"), F.sum("covered").alias("covered"))
    return out.withColumn("missed", F.col("required") - F.col("covered")).withColumn("recall", recall(F.col("covered"), F.col("required")))


def zero_miss(gold: DataFrame) -> DataFrame:
    """Threads, and share of those with no missed atom in any class."""
    whole = F.lit(True)
    for c in CLASSES:
        whole = whole & (F.size(F.array_except(f"gold.{c}", f"output.{c}")) == 0)
    return gold.agg(F.count("*").alias("gold_threads"), F.count_if(whole).alias("zero_miss")).withColumn("rate", recall(F.col("zero_miss"), F.col("gold_threads")))


def disagreements(rows: DataFrame, key: str) -> DataFrame:
    """Atoms that only one side has: ``found_by`` A (source) or B (output)."""
    sides = [
        F.struct(F.lit(c).alias("kind"), F.lit(side).alias("found_by"), F.array_except(F.col(f"{a}.{c}"), F.col(f"{b}.{c}")).alias("values"))
        for c in CLASSES for side, a, b in (("A", "source", "output"), ("B", "output", "source"))
    ]
    return rows.select(key, F.explode(F.array(*sides)).alias("x")).select(key, "x.kind", "x.found_by", F.explode("x.values").alias("value"))


def panel_vote(votes: DataFrame) -> DataFrame:
    """Verdict of each item by strict majority of the roles that found it present and real."""
    yes = F.count_if(F.col("present") & F.col("is_real"))
    out = votes.groupBy("item", "found_by").agg(yes.alias("yes"), F.count("*").alias("roles"))
    real, by_a = F.col("yes") * 2 > F.col("roles"), F.col("found_by") == "A"
    return out.withColumn("verdict", F.when(real & by_a, "B_missed").when(real, "A_gap").when(by_a, "A_false_positive").otherwise("B_hallucination"))


KNOWN = (*CLASSES, "emails")


def canonical(facts: Column, digits: int = REFERENCE_DIGITS) -> Column:
    """Facts of a model (a map of class to strings) as sets of canonical values: references, dates, amounts and addresses as the rules write them, other classes trimmed and in lower case."""
    none = F.array().cast("array<string>")
    given = lambda kind: F.coalesce(F.try_element_at(facts, F.lit(kind)), none)
    told = lambda values: F.array_join(values, " ; ")
    people = F.when(F.size(given("parties")) > 0, given("parties")).otherwise(given("emails"))
    known = F.create_map(
        F.lit("refs"), extract_refs(told(given("refs")), digits), F.lit("dates"), extract_dates(told(given("dates"))),
        F.lit("amounts"), money(extract_amounts(told(given("amounts")))), F.lit("emails"), extract_emails(told(people)),
    )
    others = F.map_filter(facts, lambda k, _: ~k.isin(*KNOWN))
    plain = F.transform_values(others, lambda _, v: F.transform(F.coalesce(v, none), lambda x: F.lower(F.trim(x))))
    return F.map_concat(known, F.coalesce(plain, F.create_map().cast("map<string,array<string>>")))


def money(amounts: Column) -> Column:
    """Amounts as currency and value."""
    return F.transform(amounts, lambda a: F.concat(a["currency"], F.lit(" "), a["value"]))


def evaluate(outputs: DataFrame, sources: DataFrame, gold: DataFrame, digits: int = REFERENCE_DIGITS) -> DataFrame:
    """``thread_id, side, kind, required, missed``: what each thread's latest output lacks of its source (side floor) and of its confirmed gold (side gold).

    ``outputs`` are ``thread_id, ts, facts`` (a map of class to strings; the latest of a thread counts,
    null: no facts), ``sources`` are ``thread_id, text`` (null: empty; outputs without one are left out),
    ``gold`` is ``thread_id, confirmed, atoms`` (a map of class to canonical values, any classes). A
    confirmed gold of no class gives one row without a kind. Written once, as its roll-ups read it again.
    """
    none = F.array().cast("array<string>")
    last = latest(outputs.where("thread_id is not null").select("thread_id", "ts", "facts"), ["thread_id"], "ts")
    sure = gold.where("confirmed").groupBy("thread_id").agg(F.first(F.coalesce("atoms", F.create_map().cast("map<string,array<string>>"))).alias("atoms"))
    text = F.coalesce("text", F.lit(""))
    rows = last.join(sources.select("thread_id", "text"), "thread_id").join(sure, "thread_id", "left").select(
        "thread_id", "atoms", canonical(F.col("facts"), digits).alias("have"), extract_refs(text, digits).alias("refs"), extract_dates(text).alias("dates"), money(extract_amounts(text)).alias("amounts"))
    rows = materialize(rows, "evaluated")
    floor = F.explode(F.array(*(F.struct(F.lit(c).alias("kind"), F.col(c).alias("need")) for c in CLASSES))).alias("x")
    by_rule = rows.select("thread_id", F.lit("floor").alias("side"), "have", floor).select("thread_id", "side", "have", "x.kind", "x.need")
    by_hand = rows.where("atoms is not null").select("thread_id", F.lit("gold").alias("side"), "have", F.explode_outer("atoms").alias("kind", "need"))
    need, have = F.array_distinct(F.coalesce("need", none)), F.coalesce(F.try_element_at("have", F.coalesce("kind", F.lit(""))), none)
    return by_rule.unionAll(by_hand).select("thread_id", "side", "kind", F.size(need).alias("required"), F.array_sort(F.array_except(need, have)).alias("missed"))


def evaluation_recall(evaluated: DataFrame) -> DataFrame:
    """Per side and class: atoms required, covered, and recall to four places, 1 where none is required."""
    missed = F.sum(F.size("missed"))
    out = evaluated.where("kind is not null").groupBy("side", "kind").agg(F.sum("required").alias("required"), (F.sum("required") - missed).alias("covered"))
    return out.withColumn("recall", F.coalesce(recall(F.col("covered"), F.col("required")), F.lit(1.0)))


def evaluation_summary(evaluated: DataFrame) -> DataFrame:
    """One row: threads, hard misses (atoms of the source that are missed), gold threads, those without any miss, and their share (null without gold)."""
    each = evaluated.groupBy("thread_id", "side").agg(F.sum(F.size("missed")).alias("missed"))
    gold = F.col("side") == "gold"
    out = each.agg(F.count_if(~gold).alias("comprehended"), F.coalesce(F.sum(F.when(~gold, F.col("missed"))), F.lit(0)).alias("hard_misses"), F.count_if(gold).alias("gold_threads"), F.count_if(gold & (F.col("missed") == 0)).alias("zero_miss"))
    return out.withColumn("no_miss_rate", recall(F.col("zero_miss"), F.col("gold_threads")))


def floor_details(evaluated: DataFrame) -> DataFrame:
    """``thread_id, kind, missed`` of the source's atoms that an output lacks."""
    return evaluated.where((F.col("side") == "floor") & (F.size("missed") > 0)).select("thread_id", "kind", "missed")
