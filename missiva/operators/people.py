"""People and their firms: which signatures to trust, and one record for each person."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from missiva.functions.names import FREE_MAIL, company_key, company_of_domain, domain, name_from_local, own_signature, person_name
from missiva.operators.directory import duplicate_people
from missiva.session import materialize, sized

SIGNED = ("company", "position", "phone")
FILLED = ("position", "company", "company_key", "phone")


def trusted_signatures(people: DataFrame, signatures: DataFrame) -> DataFrame:
    """``people`` (``email, name``) with what their signatures say, as far as it is theirs; ``own`` where the name proves it.

    ``signatures`` has ``email, zone, company, position, phone, signed``, one row per address. A signature
    with another person's name counts for nothing. One that cannot be compared counts for nothing
    either if more people sign for that company from another domain.
    """
    none = F.array().cast("array<string>")
    rows = people.join(signatures.select("email", "zone", "signed", *SIGNED), "email", "left").withColumn("domain", domain(F.col("email")))
    own = own_signature(F.col("name"), F.col("email"), F.col("signed"))
    rows = rows.withColumn("own", F.when(F.coalesce("company", F.lit("")) != "", own)).withColumn("key", F.when(F.coalesce("own", F.lit(True)), company_key(F.col("company"))).otherwise(""))
    votes = rows.where("key <> ''").groupBy("key", "domain").agg(F.count("*").alias("__votes"))
    most = votes.groupBy("key").agg(F.max("__votes").alias("__most"))
    rows = rows.join(votes, ["key", "domain"], "left").join(most, "key", "left")
    foreign = ~F.coalesce("own", F.lit(True)) | (F.col("own").isNull() & (F.col("key") != "") & (F.col("__votes") < F.col("__most")))
    kept = {c: F.when(foreign, "").otherwise(F.coalesce(c, F.lit(""))).alias(c) for c in SIGNED}
    return rows.select(*people.columns, "domain", "signed", F.when(foreign, none).otherwise(F.coalesce("zone", none)).alias("zone"), F.coalesce("own", F.lit(False)).alias("own"), *kept.values())


def domain_firms(signed: DataFrame, order: str = "ordinal") -> DataFrame:
    """``domain, firm``: what the trusted signatures of a corporate domain call it.

    A company counts if somebody's own signature has it, if two people sign with it, or if it and the domain's
    first label contain one another: a lone foreign signature names no domain. Of these the one that
    several people have, then one of six characters or more, then the most frequent, the longest, the first. Without
    any, a signature line that is about the domain's label.
    """
    rows = signed.where(~F.col("domain").isin(*FREE_MAIL) & (F.col("domain") != ""))
    core, key = F.regexp_replace(F.substring_index("domain", ".", 1), "[^a-z0-9]", ""), company_key(F.col("company"))
    votes = rows.where("company <> ''").groupBy("domain", "company").agg(F.count("*").alias("n"), F.max("own").alias("own"))
    fits = (key != "") & (F.length(core) >= 3) & (F.contains(key, core) | F.contains(core, key))
    better = F.struct((F.col("n") < 2).alias("a"), (F.length("company") < 6).alias("b"), (-F.col("n")).alias("c"), (-F.length("company")).alias("d"), "company")
    named = votes.where(F.col("own") | (F.col("n") >= 2) | fits).groupBy("domain").agg(F.min_by("company", better).alias("firm"))
    lines = rows.join(named.select("domain"), "domain", "left_anti").withColumn("hit", company_of_domain(F.col("zone"), F.col("domain"))).where("hit <> ''")
    return named.unionByName(lines.groupBy("domain").agg(F.min_by("hit", order).alias("firm")))


def signed_directory(people: DataFrame, signatures: DataFrame, order: str = "ordinal") -> DataFrame:
    """``people`` (``email, name, count`` and ``order``, one row per address) with ``position, company, company_key, domain, phone`` from their signatures.

    The company is that of the own signature, else what the domain's people call it, else none, with the
    domain as its key; people at mail providers have none. A missing name comes from the own signature, else
    from the address.
    """
    signed = trusted_signatures(people, signatures)
    rows = signed.join(domain_firms(signed, order), "domain", "left")
    corporate = (F.col("domain") != "") & ~F.col("domain").isin(*FREE_MAIL)
    company = F.when(corporate & F.col("own"), F.col("company")).when(corporate, F.coalesce("firm", F.lit(""))).otherwise("")
    told = F.when(F.col("own"), person_name(F.col("signed"), F.col("email"))).otherwise("")
    given = lambda c: F.nullif(F.trim(c), F.lit(""))
    name = F.coalesce(given(F.col("name")), given(told), name_from_local(F.col("email")), F.lit(""))
    rows = rows.withColumn("company", company).withColumn("name", name)
    key = F.when(corporate, F.coalesce(F.nullif(company_key(F.col("company")), F.lit("")), "domain")).otherwise("")
    return rows.select(*people.columns, "position", "company", key.alias("company_key"), "domain", "phone")


def fold_members(people: DataFrame, order: str = "ordinal") -> DataFrame:
    """``email, head``: the address that each folded address goes to.

    As if people were taken by count (largest first, then by ``order``) and each one that is not yet folded took all
    later ones that are like it (see :func:`missiva.operators.directory.duplicate_people`; a name is its letters)
    and not folded either; likeness is not transitive. A person whose name is only the local part of the
    address takes nobody. Rounds: whoever has no undecided earlier likeness stays and folds all its
    later ones at once, until nobody is undecided.
    """
    rank = F.struct((-F.coalesce("count", F.lit(0))).alias("c"), F.col(order).alias("o"), F.col("email").alias("email"))
    who = F.trim(F.regexp_replace(F.lower("name"), "[^a-z ]", ""))
    ranked = people.select("email", rank.alias("rank"), (who != F.substring_index("email", "@", 1)).alias("takes"))
    side = lambda p, c: ranked.select(F.col("email").alias(c), F.col("rank").alias(f"{c}_rank"), F.col("takes").alias(f"{c}_takes"))
    pairs = duplicate_people(people.where("email like '%@%'"), who=who).hint("merge").join(side("a", "a"), "a").hint("merge").join(side("b", "b"), "b")
    ahead = F.col("a_rank") < F.col("b_rank")
    pick = lambda c: F.when(ahead, F.col(f"a{c}")).otherwise(F.col(f"b{c}"))
    edges = pairs.select(pick("").alias("first"), pick("_rank").alias("first_rank"), pick("_takes").alias("takes"), F.when(ahead, F.col("b")).otherwise(F.col("a")).alias("later")).where("takes").drop("takes")
    live = every = materialize(edges, "likeness")
    rows = live.count()
    folded = None
    while not live.isEmpty():
        # who is not a later one of anybody undecided stays; its later ones are folded
        heads = live.select(F.col("first").alias("email")).distinct().join(live.select(F.col("later").alias("email")).distinct(), "email", "left_anti")
        gone = materialize(sized(live.join(heads.withColumnRenamed("email", "first"), "first", "left_semi").select(F.col("later").alias("email")).distinct(), rows), "folded")
        folded = gone if folded is None else folded.unionAll(gone)
        for end in ("first", "later"):
            live = live.join(gone.withColumnRenamed("email", end), end, "left_anti")
        live = materialize(sized(live, rows), "likeness")
    if folded is None:
        return every.select(F.col("later").alias("email"), F.col("first").alias("head")).limit(0)
    # a folded address goes to the earliest of those that stay and are like it
    stay = every.join(folded.select(F.col("email").alias("first")), "first", "left_anti").join(folded.select(F.col("email").alias("later")), "later", "left_semi")
    return stay.groupBy("later").agg(F.min_by("first", "first_rank").alias("head")).withColumnRenamed("later", "email")


def fold_people(people: DataFrame, order: str = "ordinal", filled: Sequence[str] = FILLED) -> DataFrame:
    """``people`` with the duplicates of a person folded into the busiest address.

    Counts add up, the others' addresses and aliases become aliases, and blank fields of ``filled`` take
    the first value among the folded, in their order. One row per address is expected; rows without a name or with an address without @ stay as they
    are. Extra columns are those of the address that stays.
    """
    members = fold_members(people.where("email is not null"), order)
    rest = [c for c in people.columns if c not in ("email", "count", "aliases", *filled)]
    none = F.array().cast("array<string>")
    placed = people.hint("merge").join(members, "email", "left").withColumn("__head", F.coalesce("head", "email")).drop("head")
    own = F.col("__head").eqNullSafe(F.col("email"))
    rank = F.struct(~own, (-F.coalesce("count", F.lit(0))), F.col(order), F.col("email"))
    given = lambda c: F.when(F.coalesce(c, F.lit("")) != "", F.col(c))
    named = F.array_sort(F.collect_list(F.when(~own, F.struct(rank.alias("rank"), F.concat(F.array("email"), F.coalesce("aliases", none)).alias("names")))))
    mine = F.max(F.when(own, F.struct(F.coalesce("aliases", none).alias("aliases"), *rest)))
    by = placed.groupBy("__head").agg(
        F.sum("count").alias("count"), mine.alias("mine"), F.flatten(F.transform(named, lambda x: x["names"])).alias("names"), *(F.coalesce(F.min_by(given(c), F.when(given(c).isNotNull(), rank)), F.lit("")).alias(c) for c in filled)
    )
    out = {"email": F.col("__head"), "count": F.col("count"), "aliases": F.array_distinct(F.concat("mine.aliases", "names"))} | {c: F.col(c) for c in filled} | {c: F.col(f"mine.{c}") for c in rest}
    return by.select(*(out[c].alias(c) for c in people.columns))
