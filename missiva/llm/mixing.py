"""Mixing sources to target weights by hierarchical budgeting.

Leaves are (domain, language, source). A token budget goes down the tree: each node's budget is
shared among its children by weight, no child gets more than its subtree can give, and what it
cannot use goes to its siblings; only what a whole family cannot use has gone to the siblings of its
parent before. The level of every family has a closed form over children in order of capacity per
weight, so each level is one window over the small table of children. A leaf takes whole epochs, and
then the prefix of one more epoch, in an order given by a seeded digest, until its budget is met.

The prefix is found without ordering a leaf as a whole: digests are cut into buckets of about
``BUCKET`` documents, bucket sums give each bucket's place, and order matters within buckets only.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from missiva.session import materialize

BUCKET = 2000
#: Target weights of the registered query, by level; names that are not given weigh 1.
TARGETS = {"domain": {"domain0": 3, "domain1": 2}, "lang": {"en": 4, "de": 2}, "source": {"src0": 3, "src7": 2}}
LEAF = ("domain", "lang", "source")


def default_domain() -> Column:
    """Domain of a source: by the last character of its name."""
    return F.concat(F.lit("domain"), F.coalesce(F.ascii(F.right("source", F.lit(1))), F.lit(0)) % 3)


def _weight(column: str, weights: Mapping[str, int]) -> Column:
    out = F.lit(1)
    for name, weight in weights.items():
        out = F.when(F.col(column) == name, weight).otherwise(out)
    return out.cast("long")


def _share(children: DataFrame, parent: list[str], child: str, weights: Mapping[str, int]) -> DataFrame:
    """Budget of each child from its family's ``budget`` (one row per child, with its ``capacity``)."""
    rows = children.withColumn("w", _weight(child, weights)).withColumn("ratio", F.col("capacity").cast("double") / F.col("w"))
    family = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    order = family.orderBy("ratio", child)
    rows = (
        rows.withColumn("w_left", F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("taken", F.coalesce(F.sum("capacity").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("full", F.expr("capacity * w_left <= w * (budget - taken)"))
        .withColumn("open_budget", F.col("budget") - F.sum(F.when(F.col("full"), F.col("capacity")).otherwise(0)).over(family))
        .withColumn("open_weight", F.sum(F.when(F.col("full"), 0).otherwise(F.col("w"))).over(family))
    )
    granted = F.when(F.col("full"), F.col("capacity")).otherwise(F.expr("open_budget * w div open_weight"))
    return rows.withColumn("budget", granted).select(*children.columns)


def leaf_budgets(leaves: DataFrame, percent: int, epochs: int, weights: Mapping[str, Mapping[str, int]]) -> DataFrame:
    """``budget`` of each leaf; ``leaves`` has the columns of LEAF, ``tokens`` and ``n``."""
    top = leaves.withColumn("capacity", F.col("tokens") * epochs)
    total = leaves.agg(F.sum("tokens").alias("tokens")).first().tokens or 0
    out = None
    for depth in range(1, 4):
        keys = list(LEAF[:depth])
        nodes = top.groupBy(*keys).agg(F.sum("capacity").alias("capacity"))
        nodes = nodes.withColumn("budget", F.lit(total * percent // 100).cast("long")) if out is None else nodes.join(out, keys[:-1])
        out = _share(nodes, keys[:-1], keys[-1], weights.get(keys[-1], {})).select(*keys, "budget")
    return leaves.join(out, list(LEAF))


def mix_sources(
    docs: DataFrame, *, percent: int = 60, epochs: int = 2, seed: int = 17, weights: Mapping[str, Mapping[str, int]] | None = None, domain: Column | None = None
) -> DataFrame:
    """``doc_id, domain, lang, source, n_tokens, epoch``: one row each time a document is taken.

    Tokens are words (runs of characters other than ASCII white space). The budget is ``percent`` of
    all tokens; ``weights`` maps a level to the weights of its names (1 where none is given). No leaf
    is taken more than ``epochs`` times over. The last document of a leaf may overrun its budget.
    Null domains, languages and sources count as names of their own (empty text); null texts have no tokens
    and are taken with any prefix that reaches their place; null ids are ordered like an empty id.
    Repeated rows are taken one by one. Other columns are ignored. An empty table gives an empty
    result.
    """
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"), F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long").alias("n_tokens"))
    rows = materialize(named.withColumn("domain", F.coalesce(default_domain() if domain is None else domain, F.lit(""))).select("doc_id", *LEAF, "n_tokens"), "mix")
    leaves = rows.groupBy(*LEAF).agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("n"))
    budgets = leaf_budgets(leaves, percent, epochs, weights or {})
    plan = materialize(
        budgets.select(
            *LEAF,
            F.when(F.col("tokens") > 0, F.expr("budget div tokens")).otherwise(epochs).alias("whole"),
            F.when(F.col("tokens") > 0, F.expr("budget % tokens")).otherwise(0).alias("rest"),
            F.expr(f"greatest(1, n div {BUCKET})").alias("buckets"),
        ),
        "plan",
    )
    size = plan.count()
    placed = rows.join(F.broadcast(plan) if size <= 10_000 else plan, list(LEAF))
    # the order within the epoch that is taken in part
    placed = placed.withColumn("digest", F.md5(F.concat_ws("-", F.lit(str(seed)), (F.col("whole") + 1).cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))))
    placed = placed.withColumn("bucket", F.expr("cast(conv(substr(digest, 1, 8), 16, 10) as bigint) * buckets div 4294967296"))
    sums = placed.groupBy(*LEAF, "bucket").agg(F.sum("n_tokens").alias("held"))
    before = Window.partitionBy(*LEAF).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.coalesce(F.sum("held").over(before), F.lit(0))).drop("held")
    within = Window.partitionBy(*LEAF, "bucket").orderBy("digest", "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, -1)
    taken = placed.join(sums, [*LEAF, "bucket"]).withColumn("ahead", F.col("before") + F.coalesce(F.sum("n_tokens").over(within), F.lit(0)))
    times = F.col("whole") + F.when(F.col("ahead") < F.col("rest"), 1).otherwise(0)
    taken = taken.withColumn("times", times).where("times > 0")
    taken = taken.select("doc_id", *LEAF, "n_tokens", F.explode(F.sequence(F.lit(1).cast("long"), "times")).alias("epoch"))
    return taken.withColumn("epoch", F.col("epoch").cast("int"))


def keep_mixed(docs: DataFrame, **options) -> DataFrame:
    """Rows of ``docs`` that one epoch of the mixture takes, with their columns (rows that share an id go together)."""
    taken = mix_sources(docs, epochs=1, **options).select(F.col("doc_id").alias("__doc")).distinct()
    return docs.join(taken, F.col("doc_id").cast("long").eqNullSafe(F.col("__doc")), "left_semi")


SQL = r"""
with rows as (
  select doc_id, coalesce(lang, '') as lang, coalesce(source, '') as source,
    'domain' || (case when coalesce(source, '') = '' then 0 else ascii(right(source, 1)) end % 3) as domain,
    cast(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) as bigint) as n_tokens
  from documents),
leaves as (select domain, lang, source, cast(sum(n_tokens) as bigint) as tokens from rows group by 1, 2, 3),
total as (select cast(floor(sum(tokens) * 60 / 100) as bigint) as budget from leaves),
d0 as (select domain, case domain when 'domain0' then 3 when 'domain1' then 2 else 1 end as w, cast(sum(tokens * 2) as bigint) as capacity from leaves group by 1),
d1 as (select d0.*, budget, row_number() over (order by cast(capacity as double) / w, domain) as k from d0, total),
d2 as (select *, sum(w) over (order by k desc) as w_left, coalesce(sum(capacity) over (order by k rows between unbounded preceding and 1 preceding), 0) as taken from d1),
d3 as (select *, capacity * w_left <= w * (budget - taken) as is_full from d2),
d4 as (select *, budget - sum(case when is_full then capacity else 0 end) over () as open_budget, sum(case when is_full then 0 else w end) over () as open_weight from d3),
d as (select domain, cast(case when is_full then capacity else open_budget * w // open_weight end as bigint) as budget from d4),
l0 as (select domain, lang, case lang when 'en' then 4 when 'de' then 2 else 1 end as w, cast(sum(tokens * 2) as bigint) as capacity from leaves group by 1, 2),
l1 as (select l0.*, budget, row_number() over (partition by domain order by cast(capacity as double) / w, lang) as k from l0 join d using (domain)),
l2 as (select *, sum(w) over (partition by domain order by k desc) as w_left, coalesce(sum(capacity) over (partition by domain order by k rows between unbounded preceding and 1 preceding), 0) as taken from l1),
l3 as (select *, capacity * w_left <= w * (budget - taken) as is_full from l2),
l4 as (select *, budget - sum(case when is_full then capacity else 0 end) over (partition by domain) as open_budget, sum(case when is_full then 0 else w end) over (partition by domain) as open_weight from l3),
l as (select domain, lang, cast(case when is_full then capacity else open_budget * w // open_weight end as bigint) as budget from l4),
s1 as (select leaves.*, case source when 'src0' then 3 when 'src7' then 2 else 1 end as w, tokens * 2 as capacity, budget, row_number() over (partition by domain, lang order by cast(tokens * 2 as double) / (case source when 'src0' then 3 when 'src7' then 2 else 1 end), source) as k from leaves join l using (domain, lang)),
s2 as (select *, sum(w) over (partition by domain, lang order by k desc) as w_left, coalesce(sum(capacity) over (partition by domain, lang order by k rows between unbounded preceding and 1 preceding), 0) as taken from s1),
s3 as (select *, capacity * w_left <= w * (budget - taken) as is_full from s2),
s4 as (select *, budget - sum(case when is_full then capacity else 0 end) over (partition by domain, lang) as open_budget, sum(case when is_full then 0 else w end) over (partition by domain, lang) as open_weight from s3),
s as (select domain, lang, source, tokens, cast(case when is_full then capacity else open_budget * w // open_weight end as bigint) as granted from s4),
plan as (select domain, lang, source, case when tokens > 0 then granted // tokens else 2 end as whole, case when tokens > 0 then granted % tokens else 0 end as rest from s),
placed as (select rows.*, whole, rest, md5('17-' || cast(whole + 1 as varchar) || '-' || coalesce(cast(doc_id as varchar), '')) as digest from rows join plan using (domain, lang, source)),
taken as (select *, coalesce(sum(n_tokens) over (partition by domain, lang, source order by digest, doc_id, n_tokens rows between unbounded preceding and 1 preceding), 0) as ahead from placed)
select doc_id, domain, lang, source, n_tokens, cast(e.epoch as integer) as epoch
from taken join (select 1 as epoch union all select 2) e on e.epoch <= whole + case when ahead < rest then 1 else 0 end
"""
