"""The book of firms: names, codes, people and projects under merges and overrides; look-alikes; look-ups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from missiva.functions.names import company_key, firm_code, project_key
from missiva.operators.directory import company_projects, near_keys, resolve_chains, unique_codes
from missiva.operators.ranges import running_totals


def merged(rows: DataFrame, merges: DataFrame, key: str) -> DataFrame:
    """``rows`` with ``key`` followed through the merges (``from_key, to_key``); a cycle leaves it as it is."""
    ends = resolve_chains(merges).select(F.col("from_key").alias("__from"), F.col("to_key").alias("__to"))
    out = rows.join(ends, F.col(key) == F.col("__from"), "left")
    return out.select(*(F.coalesce("__to", key).alias(c) if c == key else F.col(c) for c in rows.columns))


def firm_book(people: DataFrame, preferences: DataFrame, merges: DataFrame, took: DataFrame) -> DataFrame:
    """``key, name, code, unverified, count, domain, description, projects``: one row a firm.

    ``people`` are ``email, company_key, company, domain``, ``preferences`` are ``key, kind, value`` (kinds
    name, code and description), ``took`` is ``project, email``. The name is the overridden one, else
    the one most people sign with (then the longest, then the first), else the domain, unverified, else
    the key. Codes are the overridden ones or made from the name, unverified from the first label of the domain, and
    unique but for overridden ones, in order of keys. People without a company key are in no firm.
    """
    rows = merged(people.where("coalesce(company_key, '') <> ''").select("email", "company_key", "company", "domain"), merges, "company_key")
    votes = rows.where("trim(coalesce(company, '')) <> ''").groupBy("company_key", "company").agg(F.count("*").alias("n"))
    agreed = votes.groupBy("company_key").agg(F.min_by("company", F.struct((-F.col("n")).alias("n"), (-F.char_length("company")).alias("c"), "company")).alias("agreed"))
    firms = rows.groupBy("company_key").agg(F.count("*").alias("count"), F.min(F.nullif("domain", F.lit(""))).alias("domain"))
    said = preferences.where("trim(coalesce(value, '')) <> ''").groupBy(F.col("key").alias("company_key")).agg(*(F.max(F.when(F.col("kind") == k, F.col("value"))).alias(f"given_{k}") for k in ("name", "code", "description")))
    on = merged(company_projects(took, people).withColumnRenamed("firm", "company_key"), merges, "company_key")
    on = on.groupBy("company_key").agg(F.array_sort(F.collect_set("project")).alias("projects"))
    domain = F.coalesce("domain", "company_key")
    unverified = F.col("given_name").isNull() & F.col("agreed").isNull()
    named = firms.join(agreed, "company_key", "left").join(said, "company_key", "left").join(on, "company_key", "left").select(
        F.col("company_key").alias("key"), F.coalesce("given_name", "agreed", domain).alias("name"), unverified.alias("unverified"), "count", domain.alias("domain"),
        F.coalesce("given_description", F.lit("")).alias("description"), F.coalesce("projects", F.array().cast("array<string>")).alias("projects"), F.col("given_code").alias("given"),
    )
    base = firm_code(F.when(F.col("unverified"), F.substring_index("domain", ".", 1)).otherwise(F.col("name")))
    coded = unique_codes(named.withColumn("code", base), "code", "key", "given")
    return coded.select("key", "name", F.col("unique_code").alias("code"), "unverified", "count", "domain", "description", "projects")


def firm_people(people: DataFrame, merges: DataFrame) -> DataFrame:
    """``key, place, email, name``: the people of each firm in order of their names (else addresses) without case; individuals under an empty key."""
    rows = people.select("email", "name", F.coalesce("company_key", F.lit("")).alias("key"))
    rows = merged(rows, merges, "key").withColumn("__by", F.lower(F.coalesce(F.nullif("name", F.lit("")), "email", F.lit(""))))
    return running_totals(rows.withColumn("__one", F.lit(1)), ["key"], ["__by", "email"], "__one").select("key", F.col("rn").alias("place"), "email", "name")


def firm_order() -> list[Column]:
    """Order of firms: named ones first, by name without case."""
    return [F.col("unverified"), F.lower("name"), F.col("key")]


def busiest_order() -> list[Column]:
    """Order of projects, and of the firms of one: the busiest first, then by name without case."""
    return [F.col("count").desc(), F.lower("name")]


def look_alikes(firms: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Verified firms that may be one: pairs ``a, b`` of keys of one beginning (five characters) at most two edits apart, and ``name, key, names``.

    The second result names the firms behind a key that is in a pair or that several names have, with their number.
    """
    named = firms.where("not unverified").select("name", company_key(F.col("name")).alias("key")).where("key <> ''")
    counts = named.groupBy("key").agg(F.count("*").alias("names"))
    pairs = near_keys(counts, block=5, least=1, letters="a-z0-9&")
    odd = pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct().withColumn("__paired", F.lit(True))
    return pairs, named.join(counts, "key").join(odd, "key", "left").where("names > 1 or __paired").select("name", "key", "names")


def project_book(records: DataFrame, merges: DataFrame) -> DataFrame:
    """``key, name, count, categories``: projects of records (``thread_id, project, category``) with merges followed.

    The name is the commonest spelling (then the shortest, then the last in order) among those whose own
    key is the project's, else among all. Categories come by frequency, then in order. The threads
    themselves stay rows: see ``project_threads``.
    """
    rows = project_threads(records, merges)
    spelled = rows.groupBy("key", "spelling").agg(F.count("*").alias("n"), F.max("own").alias("own"))
    name = spelled.groupBy("key").agg(F.max_by("spelling", F.struct("own", "n", (-F.char_length("spelling")).alias("c"), "spelling")).alias("name"), F.sum("n").alias("count"))
    kinds = rows.where("category <> ''").groupBy("key", "category").agg((-F.count("*")).alias("n")).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("n", "category"))).alias("kinds"))
    return name.join(kinds, "key", "left").select("key", "name", "count", F.coalesce(F.transform("kinds", lambda x: x["category"]), F.array().cast("array<string>")).alias("categories"))


def project_threads(records: DataFrame, merges: DataFrame) -> DataFrame:
    """``key, thread_id, category, spelling, own``: the threads of each project; ``own`` where the spelling is not one merged into it."""
    rows = records.select("thread_id", "category", F.trim(F.coalesce("project", F.lit(""))).alias("spelling")).withColumn("__own", project_key(F.col("spelling"))).where("__own <> ''")
    return merged(rows.withColumn("key", F.col("__own")), merges, "key").select("key", "thread_id", "category", "spelling", (F.col("key") == F.col("__own")).alias("own"))


def look_up(rows: DataFrame, wanted: DataFrame, key: str, merges: DataFrame | None = None) -> DataFrame:
    """``wanted`` (a column ``key``) with the rows it names, through merges if given; what is not there is left out."""
    asked = wanted.select(F.col(key).alias("asked"), F.col(key).alias("__key")).where("asked is not null").distinct()
    asked = asked if merges is None else merged(asked, merges, "__key")
    return asked.join(rows.withColumn("__key", F.col(key)), "__key").drop("__key")


def item_key(thread: Column, text: Column) -> Column:
    """Key of an item that outlives small changes of its wording: a digest of its thread and the letters and digits of its text."""
    bare = F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", " "))
    return F.substring(F.sha1(F.concat(thread.cast("string"), F.lit("|"), bare)), 1, 12)


def chips(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``kind, value, n``: the values of columns that are not blank, with their rows; counted together, in one pass."""
    each = F.array(*(F.struct(F.lit(c).alias("kind"), F.trim(F.col(c).cast("string")).alias("value")) for c in columns))
    return rows.select(F.explode(each).alias("x")).select("x.*").where("coalesce(value, '') <> ''").groupBy("kind", "value").agg(F.count("*").alias("n"))


def copies_to_take(index: DataFrame, folders: Sequence[str] = ("INBOX",)) -> DataFrame:
    """Rows of the folders named, with ``turn``, the folder's place among them; a message in two of them is taken from both."""
    turn = F.array_position(F.array(*(F.lit(f) for f in folders)), F.col("folder")).cast("int")
    return index.where(F.col("folder").isin(*folders)).withColumn("turn", turn)
