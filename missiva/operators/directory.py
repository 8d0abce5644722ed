"""People, firms and projects."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from missiva.functions.names import FREE_MAIL, company_code, company_key, domain, near
from missiva.operators.components import connected_components
from missiva.session import materialize

#: People of one name and domain that are compared each with each.
FEW_NAMESAKES = 64


def sender_rollup(mail: DataFrame) -> DataFrame:
    """Per sender: distinct messages, first and last day, newest message (ties: the later row)."""
    return mail.groupBy("sender").agg(
        F.count_distinct("message_id").alias("messages"), F.min("sent_day").alias("first_day"), F.max("sent_day").alias("last_day"), F.max_by("message_id", F.struct("sent_day", "ordinal")).alias("newest"),
    )


def firm_consensus(people: DataFrame) -> DataFrame:
    """Per domain the company key with most votes (then the longest, then the first)."""
    votes = people.select(domain(F.col("email")).alias("domain"), company_key(F.col("company")).alias("key")).where("key <> ''").groupBy("domain", "key").count()
    order = Window.partitionBy("domain").orderBy(F.desc("count"), F.desc(F.char_length("key")), "key")
    return votes.withColumn("k", F.row_number().over(order)).where("k = 1").select("domain", "key", F.col("count").alias("votes"))


def _remainders(text: Column) -> Column:
    """``text`` and what is left of it without one or two characters, each once."""
    fewer = lambda t: F.transform(F.sequence(F.lit(1), F.greatest(F.char_length(t), F.lit(1))), lambda i: F.concat(F.substring(t, 1, i - 1), F.substring(t, i + 1, F.char_length(t))))
    return F.array_distinct(F.concat(F.array(text), fewer(text), F.flatten(F.transform(fewer(text), fewer))))


def near_keys(keys: DataFrame, column: str = "key", block: int = 4, least: int = 6, letters: str = "a-z0-9") -> DataFrame:
    """Pairs of keys that share a block of first characters and differ by at most two edits.

    Two strings at most two edits apart become equal by deleting at most two characters of each, so
    the keys meet by equal remainders, not by all pairs of a block.
    """
    rows = keys.select(F.col(column).alias("a")).where(F.col(column).rlike(f"^[{letters}]{{{least},}}$")).distinct()
    posted = rows.select("a", F.explode(_remainders(F.substring("a", block + 1, F.char_length("a")))).alias("left")).select("a", F.concat(F.substring("a", 1, block), "left").alias("rest"))
    pairs = posted.hint("merge").join(posted.withColumnRenamed("a", "b"), "rest").where(F.col("a") < F.col("b")).select("a", "b").distinct()
    return pairs.where(near(F.col("a"), F.col("b")))


def company_clusters(votes: DataFrame) -> DataFrame:
    """``key, canonical, name``: clusters of near-equal company keys; ``votes`` has ``key, name, messages``.

    The canonical key is the one with most messages (ties: the first), the name the one with most
    messages over the cluster, then the longest. Keys without a near one are their own cluster.
    """
    keys = votes.groupBy("key").agg(F.sum("messages").alias("messages"))
    linked = connected_components(near_keys(keys), "a", "b")
    placed = keys.join(linked.withColumnRenamed("node", "key"), "key", "left").withColumn("component", F.coalesce("component", "key"))
    canon = placed.groupBy("component").agg(F.min_by("key", F.struct((-F.col("messages")).alias("m"), "key")).alias("canonical"))
    named = placed.select("key", "component").join(votes, "key").groupBy("component", "name").agg(F.sum("messages").alias("m"))
    best = named.groupBy("component").agg(F.min_by("name", F.struct((-F.col("m")).alias("m"), (-F.char_length("name")).alias("c"), "name")).alias("name"))
    return placed.select("key", "component").join(canon, "component").join(best, "component").select("key", "canonical", "name")


def company_owners(signatures: DataFrame) -> DataFrame:
    """``key, domain``: the domains (ties all) from which most people sign as a company; ``signatures`` has ``email, company``."""
    votes = signatures.select(company_key(F.col("company")).alias("key"), domain(F.col("email")).alias("domain")).where("key <> ''").groupBy("key", "domain").count()
    most = votes.groupBy("key").agg(F.max("count").alias("count"))
    return votes.join(most, ["key", "count"]).select("key", "domain")


def valid_merges(merges: DataFrame) -> DataFrame:
    """``merges`` (``from_key, to_key``) that are neither blank nor to themselves nor part of a cycle."""
    named = merges.where("trim(coalesce(from_key, '')) <> '' and trim(coalesce(to_key, '')) <> '' and from_key <> to_key")
    cycles = _follow(named).select(F.col("to_key").alias("from_key")).distinct()  # ends of chains are no from_key
    return named.join(cycles, "from_key", "left_anti")


def key_map(people: DataFrame, merges: DataFrame) -> DataFrame:
    """``email, key``: every address and alias of the directory with its company key, merged keys followed to their ends."""
    ends = resolve_chains(merges)
    named = people.select("email", F.explode(F.concat(F.array("email"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("address"), F.col("company_key").alias("from_key"))
    return named.join(ends, "from_key", "left").select(F.col("address").alias("email"), F.coalesce("to_key", "from_key").alias("key")).distinct()


def firm_issues(firms: DataFrame) -> DataFrame:
    """``name, code, issue`` of firms (``name, code, ordinal``) to look at: odd names, and codes that an earlier firm has."""
    name = F.col("name")
    odd = name.rlike(r"(?i)^(?:for|at|with|to|from|by|dear|re|fw|fwd)\b") | name.rlike(r"[\[\]]") | (F.char_length(F.regexp_replace(name, "[^A-Za-z0-9]", "")) < 2) | (company_key(name) == "") | (F.contains(name, F.lit(" ")) & ~name.rlike("[a-z]"))
    code = F.upper(F.coalesce("code", F.lit("")))
    again = (code != "") & (F.row_number().over(Window.partitionBy(code).orderBy("ordinal")) > 1)
    return firms.withColumn("again", again).withColumn("issue", F.explode(F.array_compact(F.array(F.when(odd, "check name"), F.when(F.col("again"), "duplicate code"))))).select("name", "code", "issue")


def contact_order(people: DataFrame) -> DataFrame:
    """People with a company first, then by company and name without case."""
    company = F.lower(F.coalesce("company", F.lit("")))
    return people.orderBy(company == "", company, F.lower(F.coalesce("name", F.lit(""))))


def _follow(merges: DataFrame, rounds: int | None = None) -> DataFrame:
    """``from_key, to_key`` after at least as many steps as there are merges, by pointer jumping; what is still a from_key then lies on a cycle."""
    if rounds is None:
        rounds = max(1, math.ceil(math.log2(max(2, merges.count()))))
    now = merges.select("from_key", "to_key")
    for _ in range(rounds):
        ahead = now.select(F.col("from_key").alias("to_key"), F.col("to_key").alias("next"))
        now = materialize(now.join(ahead, "to_key", "left").select("from_key", F.coalesce("next", "to_key").alias("to_key")), "chains")
    return now


def resolve_chains(merges: DataFrame, rounds: int | None = None) -> DataFrame:
    """``from_key, to_key`` with every chain followed to its end; what leads to a cycle stays itself."""
    now = _follow(merges, rounds)
    ends = now.join(merges.select(F.col("from_key").alias("to_key")), "to_key", "left_semi").select("from_key").withColumn("cyclic", F.lit(True))
    return now.join(ends, "from_key", "left").select("from_key", F.when(F.col("cyclic"), F.col("from_key")).otherwise(F.col("to_key")).alias("to_key"))


def _in_turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``at, code`` of rows ``stem, base, given, at`` in order of stem and time, after one row without ``at`` for each base of a stem.

    Per base only the next number and the numbers ahead of it that others hold are kept.
    """
    now, following, ahead = None, {}, {}
    for batch in batches:
        codes = []
        for stem, base, code, at in zip(*(batch.column(c).to_pylist() for c in ("stem", "base", "given", "at"))):
            if stem != now:
                now, following, ahead = stem, {}, {}
            if at is None:
                following[base], ahead[base] = 1, set()
                codes.append(None)
                continue
            codes.append(code)
            if code is None:
                n = following[base]
                while n in ahead[base]:
                    ahead[base].remove(n)
                    n += 1
                following[base] = n + 1
                codes[-1] = code = base + (str(n) if n > 1 else "")
            for cut in range(len(stem), len(code) + 1):
                number = code[cut:]
                if code[:cut] in following and number != "1" and not number.startswith("0"):
                    x = int(number or 1)
                    if x >= following[code[:cut]]:
                        ahead[code[:cut]].add(x)
        yield pa.RecordBatch.from_arrays([batch.column("at"), pa.array(codes, pa.string())], ["at", "code"])


def unique_codes(firms: DataFrame, base: str = "code", order: str = "first_seen", given: str | None = None) -> DataFrame:
    """``firms`` with ``unique_code``: in the order of ``order`` (unique), each takes the first of its base, base2, base3, ... that no earlier one has.

    A firm with a code in the column ``given`` keeps it, even if another has it; later firms make way for it. Codes can
    only meet if they are the same without the digits at their ends (AB, AB2: the third firm's own code may be the second's),
    so the firms of such a stem are numbered in one pass over them in order, as the rule asks.
    """
    fixed = F.lit(None).cast("string") if given is None else F.nullif(F.trim(given), F.lit(""))
    rows = firms.withColumn("__given", fixed).withColumn("__base", F.coalesce(base, F.lit("")))
    turns = rows.select(F.when(F.col("__given").isNull(), F.col("__base")).alias("base"), F.col("__given").alias("given"), F.col(order).alias("at"))
    every = turns.unionByName(turns.where("base is not null").select("base").distinct(), allowMissingColumns=True)
    every = every.withColumn("stem", F.regexp_replace(F.coalesce("given", "base"), "[0-9]+$", ""))
    sorted_ = every.repartition("stem").sortWithinPartitions("stem", F.col("at").asc_nulls_first())
    found = sorted_.mapInArrow(_in_turn, StructType([turns.schema["at"], StructField("code", StringType())])).where("code is not null")
    coded = rows.hint("merge").join(found.select(F.col("at").alias(order), F.col("code").alias("__code")), order, "left")
    return coded.select(*firms.columns, F.coalesce("__given", "__code").alias("unique_code"))


def project_index(records: DataFrame) -> DataFrame:
    """Per project: threads, categories by frequency, and its share of all."""
    by = records.groupBy("project", "category").count()
    order = F.array_sort(F.collect_list(F.struct((-F.col("count")).alias("n"), F.col("category").alias("category"))))
    return by.groupBy("project").agg(F.sum("count").alias("threads"), F.array_join(F.transform(order, lambda x: x["category"]), "|").alias("categories"))


def project_contacts(took: DataFrame, people: DataFrame) -> DataFrame:
    """``project, email, name``: everybody who took part (``project, email``), unknown addresses with an empty name."""
    known = people.groupBy("email").agg(F.min("name").alias("name"))
    return took.distinct().join(known, "email", "left").select("project", "email", F.coalesce("name", F.lit("")).alias("name"))


def participant_firms(took: DataFrame, people: DataFrame) -> DataFrame:
    """``took`` with the firm of each address: its own in the directory, else that of its corporate domain; empty if neither is known."""
    own = people.where("coalesce(company_key, '') <> ''").groupBy("email").agg(F.min("company_key").alias("__own"))
    hosts = people.where((F.coalesce("company_key", F.lit("")) != "") & ~F.col("domain").isin(*FREE_MAIL)).groupBy("domain").agg(F.min("company_key").alias("__host"))
    rows = took.withColumn("domain", domain(F.col("email"))).join(own, "email", "left").join(hosts, "domain", "left")
    return rows.select(*took.columns, F.coalesce("__own", "__host", F.lit("")).alias("firm"))


def project_companies(took: DataFrame, people: DataFrame) -> DataFrame:
    """``project, firm, people``: the firms that worked on each project, and with how many people."""
    return participant_firms(took.distinct(), people).where("firm <> ''").groupBy("project", "firm").agg(F.count("*").alias("people"))


def company_projects(took: DataFrame, people: DataFrame) -> DataFrame:
    """``firm, project``: the projects that each firm worked on."""
    return participant_firms(took.distinct(), people).where("firm <> ''").select("firm", "project").distinct()


def green_book(people: DataFrame, overrides: DataFrame) -> DataFrame:
    """``key, name, people, code, unverified`` of every firm: its overridden name, else the most common one that people sign with (then the longest), else its domain, unverified.

    People without a company key are individuals and in no firm. Codes are unique, in order of keys.
    """
    rows = people.where("coalesce(company_key, '') <> ''")
    votes = rows.where("coalesce(company, '') <> ''").groupBy("company_key", "company").agg(F.count("*").alias("n"))
    agreed = votes.groupBy("company_key").agg(F.min_by("company", F.struct((-F.col("n")).alias("n"), (-F.char_length("company")).alias("c"), "company")).alias("agreed"))
    firms = rows.groupBy("company_key").agg(F.count("*").alias("people"), F.min("domain").alias("domain")).join(agreed, "company_key", "left")
    firms = firms.join(overrides.select(F.col("key").alias("company_key"), F.col("name").alias("given")), "company_key", "left")
    named = firms.select(F.col("company_key").alias("key"), F.coalesce("given", "agreed", "domain").alias("name"), "people", (F.col("given").isNull() & F.col("agreed").isNull()).alias("unverified"))
    return unique_codes(named.withColumn("code", company_code(F.col("name"))), "code", "key").withColumn("code", F.col("unique_code")).drop("unique_code")


def fill_blanks(people: DataFrame, found: DataFrame, fields: Sequence[str]) -> DataFrame:
    """People with blank fields filled from contacts found elsewhere (``email, ordinal`` and the fields): the first value that is not blank."""
    first = found.groupBy("email").agg(*(F.min_by(F.when(F.trim(f) != "", F.trim(f)), F.when(F.trim(f) != "", F.col("ordinal"))).alias(f"__{f}") for f in fields))
    return people.join(first, "email", "left").select(*(F.coalesce(F.nullif(F.col(c), F.lit("")), f"__{c}", F.lit("")).alias(c) if c in fields else F.col(c) for c in people.columns))


def duplicate_people(people: DataFrame, most: int = 2, who: Column | None = None) -> DataFrame:
    """Pairs ``a, b`` of addresses of one name that share the domain with near local parts, or the local part with near domains.

    ``who`` is what counts as the name, by default the name without case and with single blanks. The people of one
    name and domain (or local part) meet directly if they are few, else by equal remainders after at most two deletions.
    """
    who = F.lower(F.trim(F.regexp_replace("name", r"\s+", " "))) if who is None else who
    rows = people.select("email", who.alias("who"), F.substring_index("email", "@", 1).alias("local"), domain(F.col("email")).alias("host")).where("who <> ''").distinct()
    found = []
    for same, close in (("host", "local"), ("local", "host")):
        sized = rows.select("email", "who", F.col(same).alias("same"), F.col(close).alias("close")).withColumn("n", F.count("*").over(Window.partitionBy("who", "same")))
        small, large = sized.where(F.col("n").between(2, FEW_NAMESAKES)), sized.where(F.col("n") > FEW_NAMESAKES)
        posted = large.select("email", "who", "same", "close", F.explode(_remainders(F.col("close"))).alias("rest"))
        for side, meet in ((small, ["who", "same"]), (posted, ["who", "same", "rest"])):
            other = side.select(F.col("email").alias("b"), F.col("close").alias("__close"), *meet)
            pairs = side.hint("merge").join(other, meet).where((F.col("email") < F.col("b")) & near(F.col("close"), F.col("__close"), most))
            found.append(pairs.select(F.col("email").alias("a"), "b"))
    return reduce(DataFrame.unionAll, found).distinct()
