"""Open obligations and matters: ranking, gauges, keywords, rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HORIZON = 30
#: Rules that are broadcast rather than shuffled with the words of all items.
FEW_RULES = 10_000


def is_open(status: Column) -> Column:
    return ~F.lower(F.coalesce(status, F.lit("open"))).isin("done", "superseded")


def open_obligations(actions: DataFrame, today: str) -> DataFrame:
    """Open actions that are not known to be someone else's, with days left and overdue flag (null without a valid due date)."""
    due = F.try_to_date("due_canonical", "yyyy-MM-dd")
    left = F.datediff(due, F.lit(today).cast("date"))
    return actions.where(F.coalesce(F.col("is_mine"), F.lit(True)) & is_open(F.col("status"))).withColumn("days_left", left).withColumn("overdue", F.coalesce(left < 0, F.lit(False)))


def priority_rank(priority: Column) -> Column:
    return F.when(F.lower(priority) == "high", 0).when(F.lower(priority) == "low", 2).otherwise(1)


def need_you(actions: DataFrame, today: str, group: Sequence[str], tie: str) -> DataFrame:
    """Open obligations of each group, dated ones first by days left, then by priority."""
    w = Window.partitionBy(*group).orderBy(F.col("days_left").asc_nulls_last(), priority_rank(F.col("priority")), tie)
    return open_obligations(actions, today).withColumn("rank", F.row_number().over(w))


def gauge(days_left: Column) -> Column:
    """Urgency from 0 (undated) over 4 (far) to 100 (overdue)."""
    share = F.bround((HORIZON - F.least(days_left, F.lit(HORIZON))) / HORIZON * 100, 0).cast("int")
    return F.when(days_left.isNull(), 0).when(days_left < 0, 100).otherwise(F.greatest(F.lit(4), F.least(F.lit(100), share)))


def counters(items: DataFrame) -> DataFrame:
    """Tracked, overdue, due within a week, undated."""
    return items.agg(
        F.count("*").alias("tracked"), F.count_if("overdue").alias("overdue"), F.count_if(F.col("days_left").between(0, 7)).alias("due_soon"), F.count_if(F.col("days_left").isNull()).alias("undated")
    )


def keyword_scores(items: DataFrame, keywords: DataFrame, key: str, text: str) -> DataFrame:
    """Sum of the weights of the keywords that an item's text holds as words."""
    terms = items.select(key, F.explode(F.array_distinct(F.split(F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " ")), " "))).alias("term"))
    return terms.join(keywords, "term").groupBy(key).agg(F.sum("weight").alias("score"))


def _pieces(text: Column, longest: int) -> Column:
    """All distinct substrings of one to ``longest`` characters."""
    starts = F.sequence(F.lit(1), F.greatest(F.char_length(text), F.lit(1)))
    return F.array_distinct(F.flatten(F.transform(starts, lambda i: F.array(*(F.substring(text, i, F.lit(n)) for n in range(1, longest + 1))))))


def match_rules(items: DataFrame, rules: DataFrame, key: str) -> DataFrame:
    """Newest rule that applies to each item: keyword or phrase as whole words of its text, part of its sender, or equal project.

    Phrases in scripts without word breaks apply where the text contains them. All rules meet items by
    equal keys, so neither side has to be small: a phrase by its first word (or first two characters),
    then it is looked for; a part of a sender by its first three characters, among distinct senders. Up to
    ``FEW_RULES`` rules are sent to the items; the items, whose words a size estimate does not see, never are.
    """
    rule_side = F.broadcast if rules.limit(FEW_RULES + 1).count() <= FEW_RULES else lambda df: df.hint("merge")
    few = rules.select("kind", F.lower(F.trim("match")).alias("match"), "category", F.col("ordinal").alias("__rule")).where("match <> ''")
    plain = F.col("match").rlike("^[\\x00-\\x7F]*$")
    first_word = F.regexp_extract("match", "[a-z0-9]+", 0)
    said = few.where("kind = 'keyword'").withColumn("piece", F.when(plain & (first_word != ""), first_word).otherwise(F.substring("match", 1, 2)))
    low = F.lower(F.coalesce("text", F.lit("")))
    words = F.concat(F.regexp_extract_all(low, F.lit("[a-z0-9]+"), F.lit(0)), F.flatten(F.transform(F.regexp_extract_all(low, F.lit(r"[^\x00-\x7F]+"), F.lit(0)), lambda r: _pieces(r, 2))))
    met = items.select(key, low.alias("__low"), F.explode(F.array_distinct(words)).alias("piece")).join(rule_side(said), "piece")
    whole = F.regexp_like("__low", F.concat(F.lit(r"(?U)\b\Q"), F.replace("match", F.lit(r"\E")), F.lit(r"\E\b")))
    by_word = met.where(F.when(plain, whole).otherwise(F.contains("__low", F.col("match"))))
    sent = few.where("kind = 'sender'").withColumn("piece", F.substring("match", 1, 3))
    senders = items.select("sender").distinct().withColumn("piece", F.explode(_pieces(F.lower("sender"), 3))).join(rule_side(sent), "piece").where(F.contains(F.lower("sender"), F.col("match")))
    by_sender = items.select(key, "sender").hint("merge").join(senders, "sender")
    by_project = items.select(key, F.lower(F.trim(F.regexp_replace("project", r"\s+", " "))).alias("match")).join(rule_side(few.where("kind = 'project'")), "match")
    hits = by_word.select(key, "category", "__rule").unionByName(by_sender.select(key, "category", "__rule")).unionByName(by_project.select(key, "category", "__rule"))
    return hits.groupBy(key).agg(F.max_by("category", "__rule").alias("category"), F.max("__rule").alias("rule"))


# Words that are no signals.
NOT_SIGNALS = (
    "the", "a", "an", "and", "or", "to", "of", "for", "in", "on", "at", "is", "are", "be", "by", "with", "from", "this", "that", "your", "our", "you", "we",
    "please", "kindly", "can", "could", "would", "should", "will", "shall", "need", "needs", "ensure", "make", "sure",
)


def item_signals(refs: Column, project: Column, category: Column, domain: Column, parties: Column, said: Column, most: int = 14) -> Column:
    """``{term, weight}`` of an item, heaviest first: references and project 3, category and parties 2, domain and longer words 1; a term counts once, at its most."""
    listed = lambda xs, w: F.transform(F.coalesce(xs, F.array().cast("array<string>")), lambda x: F.struct(F.lower(F.trim(x)).alias("term"), F.lit(w).alias("weight")))
    words = F.regexp_extract_all(F.lower(F.coalesce(said, F.lit(""))), F.lit("[a-z][a-z-]{3,}"), F.lit(0))
    every = F.concat(listed(refs, 3), listed(F.array(project), 3), listed(F.array(category), 2), listed(F.array(domain), 1), listed(parties, 2), listed(words, 1))
    every = F.filter(every, lambda x: x["term"].isNotNull() & (x["term"] != "") & ~x["term"].isin(*NOT_SIGNALS))
    terms = F.array_distinct(F.transform(every, lambda x: x["term"]))
    best = F.transform(terms, lambda t, i: F.struct((-F.array_max(F.transform(F.filter(every, lambda x: x["term"] == t), lambda x: x["weight"]))).alias("w"), i.alias("i"), t.alias("term")))
    return F.slice(F.transform(F.array_sort(best), lambda x: F.struct(x["term"].alias("term"), (-x["w"]).alias("weight"))), 1, most)


def learn_keywords(pinned: DataFrame, signals: str) -> DataFrame:
    """``term, weight``: the weights of the signals of all pinned items, summed."""
    return pinned.select(F.explode(signals).alias("x")).groupBy("x.term").agg(F.sum("x.weight").alias("weight"))


def clean_themes(themes: Column, most: int = 6, terms: int = 10) -> Column:
    """Themes ``{label, terms}`` with a label and terms, in lower case, the first ten terms of the first six themes."""
    tidy = F.transform(themes, lambda t: F.struct(F.trim(t["label"]).alias("label"), F.slice(F.filter(F.transform(t["terms"], lambda x: F.lower(F.trim(x))), lambda x: x != ""), 1, terms).alias("terms")))
    return F.slice(F.filter(tidy, lambda t: (t["label"] != "") & (F.size(t["terms"]) > 0)), 1, most)


def suggested(obligation: Column, score: Column, terms: Column, themes: Column) -> Column:
    """Is an item worth suggesting: an obligation, a keyword score of 4 or more, or two terms of one theme."""
    return F.coalesce(obligation, F.lit(False)) | (F.coalesce(score, F.lit(0)) >= 4) | F.exists(themes, lambda t: F.size(F.array_intersect(t["terms"], terms)) >= 2)
