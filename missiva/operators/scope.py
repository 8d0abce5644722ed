"""Scopes, work lists and summaries: which rows a run takes, and what it reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from missiva.functions.atoms import REFERENCE_DIGITS, extract_atoms
from missiva.operators.archive import coverage, latest


def unmeasured(rows: DataFrame, *columns: str) -> DataFrame:
    """One row: for each column the rows that a filter on it cannot place."""
    return rows.agg(F.count("*").alias("n"), *(F.count_if(F.col(c).isNull()).alias(f"no_{c}") for c in columns))


def resume(rows: DataFrame, done: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """The rows whose keys are not done yet, and one row with the numbers of rows left and skipped."""
    marked = rows.join(done.select(*keys).distinct().withColumn("__done", F.lit(True)), list(keys), "left")
    report = marked.agg(F.count_if(F.col("__done").isNull()).alias("left"), F.count_if("__done").alias("skipped"))
    return marked.where("__done is null").drop("__done"), report


def link_scope(links: DataFrame, mail: DataFrame, providers: Sequence[str] | None = None, only: DataFrame | None = None, first: str | None = None, last: str | None = None) -> DataFrame:
    """Links of some providers and messages, in a window of days of the mail they stand in; undated mail is outside any window."""
    if providers is not None:
        links = links.where(F.col("provider").isin(*providers))
    if only is not None:
        links = links.join(only.select("message_id").distinct(), "message_id", "left_semi")
    if first is not None or last is not None:
        dated = mail.where(F.col("sent_day").between(first or "", last or "9999-99-99")).select("message_id").distinct()
        links = links.join(dated, "message_id", "left_semi")
    return links


def thread_scope(threads: DataFrame, project: str | None = None, first: str | None = None, last: str | None = None) -> DataFrame:
    """Threads of one project or of a window of days (by the last day, else the first), or all."""
    if project is not None:
        threads = threads.where(F.col("project") == project)
    if first is not None or last is not None:
        threads = threads.where(F.coalesce("end_day", "start_day").between(first or "", last or "9999-99-99"))
    return threads


def backlog(current: DataFrame, recorded: DataFrame, keys: Sequence[str], *, redo: bool = False, include_stale: bool = True, only: DataFrame | None = None) -> DataFrame:
    """Threads to work on: never recorded, stale if wanted, all with ``redo``; of those named in ``only``, if given."""
    states = coverage(current, recorded, keys)
    if not redo:
        states = states.where(F.col("state").isin("pending", "stale") if include_stale else F.col("state") == "pending")
    return states if only is None else states.join(only.select(*keys).distinct(), list(keys), "left_semi")


def token_estimate(members: DataFrame, keys: Sequence[str], size: str, most: int = 200_000) -> DataFrame:
    """Tokens of each thread: a quarter of the bytes of its members, each counted up to ``most``; at least 1."""
    return members.groupBy(*keys).agg(F.greatest(F.lit(1), F.floor(F.sum(F.least(F.col(size), F.lit(most))) / 4)).cast("long").alias("tokens"))


def capped(rows: DataFrame, order: Sequence[Column], most: int) -> tuple[DataFrame, DataFrame]:
    """The first rows in an order, and one row with the number that is left for another run."""
    left = rows.agg(F.greatest(F.lit(0), F.count("*") - most).alias("backlog"))
    return rows.orderBy(*order).limit(most), left


def page(rows: DataFrame, order: str, after: object | None, size: int) -> DataFrame:
    """A page of a list by the key that it is ordered by, after the last key shown."""
    rows = rows if after is None else rows.where(F.col(order) > F.lit(after))
    return rows.orderBy(order).limit(size)


def focus(items: DataFrame, pins: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Pinned items, and the others."""
    named = pins.select(key).distinct()
    return items.join(named, key, "left_semi"), items.join(named, key, "left_anti")


def listed(items: DataFrame, *, important: bool = False, review: bool = False, domain: str | None = None, category: str | None = None, words: str = "") -> DataFrame:
    """Items by importance, need of review, domain, category, and a part of their text."""
    if important:
        items = items.where("importance = 'high'")
    if review:
        items = items.where("needs_review")
    for name, value in (("domain", domain), ("category", category)):
        if value is not None:
            items = items.where(F.col(name) == value)
    return items.where(F.contains(F.lower("text"), F.lit(words.lower()))) if words else items


def body_text(messages: DataFrame, keys: Sequence[str], order: str, text: str) -> DataFrame:
    """The texts of a thread's messages in order, each without its first line (its header)."""
    body = F.when(F.contains(text, F.lit("\n")), F.regexp_extract(text, r"(?s)^[^\n]*\n(.*)$", 1)).otherwise(F.col(text))
    told = messages.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("k"), body.alias("body")))).alias("all"))
    return told.select(*keys, F.array_join(F.transform("all", lambda x: x["body"]), "\n\n").alias("text"))


def stitched(messages: DataFrame, files: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Thread text of messages (``tag, header, body``) with their attachments and shared files (``name, kind, text, note``) after them, unread ones with a line that says so."""
    what = F.when(F.col("kind") == "link", "shared file").otherwise("attachment")
    read = F.coalesce("text", F.lit("")) != ""
    line = F.when(read, F.concat(F.lit("["), what, F.lit(": "), "name", F.lit("]\n"), "text")).otherwise(F.concat(F.lit("["), what, F.lit(" NOT read: "), "name", F.lit(" — "), F.coalesce("note", F.lit("")), F.lit("]")))
    own = files.withColumn("line", line).groupBy("message_id").agg(F.array_sort(F.collect_list(F.struct("name", "line"))).alias("files"))
    parts = F.concat(F.array(F.concat_ws("\n", F.concat_ws(" ", "tag", "header"), "body")), F.coalesce(F.transform("files", lambda x: x["line"]), F.array().cast("array<string>")))
    rows = messages.join(own, "message_id", "left").select(*keys, F.col(order).alias("k"), F.array_join(parts, "\n\n").alias("part"))
    return rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("k", "part"))).alias("all")).select(*keys, F.array_join(F.transform("all", lambda x: x["part"]), "\n\n----\n\n").alias("text"))


def folder_counts(archive: DataFrame, source: DataFrame) -> DataFrame:
    """Messages of each folder in the archive and at the source (``folder, n``), and how many are missing."""
    have = archive.groupBy("folder").agg(F.count("*").alias("archived"))
    both = source.select("folder", F.col("n").alias("at_source")).join(have, "folder", "full_outer").fillna(0, ["at_source", "archived"])
    return both.withColumn("missing", F.greatest(F.lit(0), F.col("at_source") - F.col("archived")))


def with_record(threads: DataFrame, records: DataFrame) -> DataFrame:
    """Threads with their latest record by root, else by thread id: a late message changes the id of a thread, not its root."""
    fields = [c for c in records.columns if c not in ("thread_id", "root_id")]
    by = lambda key: latest(records.where(F.col(key).isNotNull()).select(key, *fields), [key], "ts").select(key, F.struct(*fields).alias(f"__{key}"))
    found = threads.join(by("root_id"), "root_id", "left").join(by("thread_id"), "thread_id", "left")
    return found.select(*threads.columns, F.coalesce("__root_id", "__thread_id").alias("record"))


def file_counts(members: DataFrame, links: DataFrame) -> DataFrame:
    """Downloaded files of each thread (``thread_id``): links that name a member by id, and links without an id that name its path."""
    got = links.where("status = 'downloaded'")
    by_id = members.select("thread_id", "message_id").distinct().join(got.where("message_id <> ''").select("message_id"), "message_id").select("thread_id")
    by_path = members.select("thread_id", "path").distinct().join(got.where("coalesce(message_id, '') = ''").select("path"), "path").select("thread_id")
    return by_id.unionAll(by_path).groupBy("thread_id").agg(F.count("*").alias("files"))


def updated(table: DataFrame, updates: DataFrame, keys: Sequence[str], order: str | None = None) -> DataFrame:
    """``table`` with the columns of ``updates`` where these are not null; updates of keys that it lacks are not added.

    Of several updates of one key the last by the column ``order`` counts, without one the largest.
    """
    values = [c for c in updates.columns if c not in keys]
    updates = latest(updates, keys, *([order] if order else values))
    updates = updates.drop(order) if order and order not in table.columns else updates
    fields = [c for c in updates.columns if c not in keys]
    named = updates.select(*keys, *(F.col(c).alias(f"__{c}") for c in fields))
    return table.join(named, list(keys), "left").select(*(F.coalesce(f"__{c}", c).alias(c) if c in fields else F.col(c) for c in table.columns))


def overridden(records: DataFrame, overrides: DataFrame, taxonomy: DataFrame, key: str = "thread_id") -> DataFrame:
    """Records with the operator's latest override (``domain, category, ts``) that the taxonomy has; others are ignored."""
    valid = overrides.join(taxonomy.select("domain", "category"), ["domain", "category"], "left_semi")
    last = latest(valid.select(key, "ts", F.col("domain").alias("__d"), F.col("category").alias("__c")), [key], "ts").drop("ts")
    ruled = F.col("__d").isNotNull()
    out = records.join(last, key, "left")
    return out.select(*(F.coalesce(f"__{c[0]}", c).alias(c) if c in ("domain", "category") else F.col(c) for c in records.columns), F.when(ruled, "operator").otherwise("model").alias("method"))


def code_in_use(firms: DataFrame, code: str, but: str) -> DataFrame:
    """Firms other than ``but`` that have a code, whatever its case."""
    return firms.where((F.upper("code") == code.upper()) & (F.col("key") != but))


def distinct_names(index: DataFrame) -> DataFrame:
    """``path`` made unique: a later message of another content at a path gets its key behind the name."""
    first = Window.partitionBy("folder", "path")
    other = F.col("sha256") != F.min_by("sha256", "ordinal").over(first)
    stem, ext = F.regexp_extract("path", r"^(.*?)(\.[^.]*)?$", 1), F.regexp_extract("path", r"^(.*?)(\.[^.]*)?$", 2)
    return index.withColumn("path", F.when(other, F.concat(stem, F.lit("_"), "key", ext)).otherwise(F.col("path")))


def adjudication(verdicts: DataFrame) -> DataFrame:
    """One row: disagreements, those that are real, and the side to improve."""
    said = F.col("verdict")
    return verdicts.agg(F.count("*").alias("disagreements"), F.count_if(said != "same").alias("confirmed_real"), F.count_if(said == "b_better").alias("improve_a"), F.count_if(said == "a_better").alias("improve_b"))


def throughput(events: DataFrame, run: str, done: str, total: str, seconds: str) -> DataFrame:
    """Per run: the most done of the total, its rate a minute, and the minutes left (null before any is done)."""
    by = events.groupBy(run).agg(F.max(done).alias("done"), F.max(total).alias("total"), F.max(seconds).alias("seconds"))
    rate = F.when(F.col("seconds") > 0, F.col("done") * 60.0 / F.col("seconds"))
    return by.withColumn("rate", F.round(rate, 4)).withColumn("minutes_left", F.when(F.col("done") > 0, F.round((F.col("total") - F.col("done")) / rate, 4)))


def observed(rows: DataFrame, name: str, **counts: Column) -> tuple[DataFrame, Observation]:
    """``rows`` with counts that are taken while another action runs over them."""
    seen = Observation(name)
    return rows.observe(seen, F.count(F.lit(1)).alias("rows"), *(c.alias(k) for k, c in counts.items())), seen


def matters_order(items: DataFrame, mode: str = "expiry") -> DataFrame:
    """Matters by expiry (undated last), recency, importance, domain or category; ties by expiry."""
    expiry = [F.col("due_day").isNull(), F.col("due_day"), F.col("key")]
    first = {"expiry": [], "recency": [F.coalesce("last_day", F.lit("")).desc()], "importance": [F.when(F.col("importance") == "high", 0).when(F.col("importance") == "clear", 2).otherwise(1)],
             "domain": [F.lower(F.coalesce("domain", F.lit(""))), F.lower(F.coalesce("category", F.lit("")))], "category": [F.lower(F.coalesce("category", F.lit("")))]}
    return items.orderBy(*first[mode], *expiry)


def display_date(iso: Column) -> Column:
    """A date as 02 Jan 2024; what is no date stays as it is."""
    day = F.substring(iso, 1, 10).try_cast("date")
    return F.coalesce(F.date_format(day, "dd MMM yyyy"), iso)


def fact_tags(facts: Column, tags: Column) -> Column:
    """The facts of a record as an item shows them: references, amounts as currency and value, percentages, facet tags."""
    none = F.array().cast("array<string>")
    amounts = F.transform(facts["amounts"], lambda a: F.trim(F.concat_ws(" ", a["currency"], a["value"])))
    return F.struct(F.coalesce(facts["refs"], none).alias("refs"), F.coalesce(amounts, none).alias("amounts"), F.coalesce(facts["percents"], none).alias("percents"), F.coalesce(tags, none).alias("facet_tags"))


def gold_candidates(threads: DataFrame, text: str, version: int = 1, digits: int = REFERENCE_DIGITS) -> DataFrame:
    """``thread_id, confirmed, gold_version, atoms``: what the rules find in a thread's text, to be confirmed by hand."""
    return threads.select("thread_id", F.lit(False).alias("confirmed"), F.lit(version).alias("gold_version"), extract_atoms(F.col(text), digits).alias("atoms"))


def preferences(events: DataFrame) -> DataFrame:
    """``key, kind, value``: the last value of each preference (``key, kind, value, ts``), cleaned.

    Codes are upper case and of at most 8 characters, names of 80, descriptions of 240; importance is
    high, normal or clear, anything else normal. Blank values clear a preference.
    """
    value, kind = F.trim(F.coalesce("value", F.lit(""))), F.col("kind")
    clean = (
        F.when(kind == "code", F.upper(F.substring(value, 1, 8))).when(kind == "name", F.substring(value, 1, 80)).when(kind == "description", F.substring(value, 1, 240))
        .when(kind == "importance", F.when(value.isin("high", "normal", "clear"), value).otherwise("normal")).otherwise(value)
    )
    return latest(events.withColumn("value", clean), ["key", "kind"], "ts").where("value <> ''").select("key", "kind", "value")


def effective_taxonomy(given: DataFrame, safety_net: str) -> DataFrame:
    """``domain, category, safety_net`` of a profile (``domain, category, ordinal``): blank names go, names that differ by case only count once, as first written; the safety net is marked, or the last category stands in for it."""
    rows = given.where("trim(coalesce(domain, '')) <> '' and trim(coalesce(category, '')) <> ''").withColumns({"domain": F.trim("domain"), "category": F.trim("category")})
    first = rows.groupBy(F.lower("domain").alias("d"), F.lower("category").alias("c")).agg(F.min_by("category", "ordinal").alias("category"), F.min("ordinal").alias("ordinal"))
    spelled = rows.groupBy(F.lower("domain").alias("d")).agg(F.min_by("domain", "ordinal").alias("domain"))
    ends = first.agg(F.max(F.when(F.col("c") == safety_net.lower(), F.col("ordinal"))).alias("named"), F.max("ordinal").alias("last"))
    marked = first.join(spelled, "d").crossJoin(F.broadcast(ends))  # one row
    return marked.select("domain", "category", (F.col("ordinal") == F.coalesce("named", "last")).alias("safety_net"))


def rebuild_report(people: DataFrame) -> DataFrame:
    """One row about a directory (``email, company_key, aliases``): people, firms, addresses folded into others."""
    return people.agg(F.count("*").alias("people"), F.count_distinct(F.nullif("company_key", F.lit(""))).alias("firms"), F.sum(F.greatest(F.lit(0), F.size(F.coalesce("aliases", F.array().cast("array<string>"))))).alias("folded"))
