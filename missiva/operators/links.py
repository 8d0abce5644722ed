"""Share links: catalogue upserts, outcome reuse, roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def new_links(found: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Links found that the catalogue lacks, once each."""
    return found.dropDuplicates(["message_id", "url"]).join(catalogue, ["message_id", "url"], "left_anti")


def reuse_outcomes(links: DataFrame) -> DataFrame:
    """Pending records take the best outcome of their url: downloaded, else dead."""
    rank = F.when(F.col("status") == "downloaded", 2).when(F.col("status") == "dead", 1).otherwise(0)
    best = links.groupBy("url").agg(F.max(rank).alias("best"))
    told = F.when(F.col("best") == 2, "downloaded").when(F.col("best") == 1, "dead").otherwise("pending")
    return links.join(best, "url").withColumn("outcome", F.when(F.col("status") == "pending", told).otherwise(F.col("status"))).drop("best")


def link_state(links: DataFrame, key: str) -> DataFrame:
    """Per key: all, fetched and pending links."""
    return links.groupBy(key).agg(F.count("*").alias("total"), F.count_if(F.col("status") == "downloaded").alias("fetched"), F.count_if(F.col("status") == "pending").alias("pending"))


def links_of_messages(links: DataFrame, messages: DataFrame) -> DataFrame:
    """Links of messages by message id or by path, each pair once: two equi joins, never a disjunction."""
    by_id = links.where("message_id is not null").join(messages.select("thread", "message_id"), "message_id").select("thread", "link_id")
    by_path = links.where("path is not null").join(messages.select("thread", "path"), "path").select("thread", "link_id")
    return by_id.unionByName(by_path).dropDuplicates()


def direct_url(url: Column, provider: Column) -> Column:
    """Address of a plain download where the provider has one: Dropbox with dl=1 last, a Drive file by its id; null else."""
    base, fragment = F.substring_index(url, "#", 1), F.regexp_extract(url, "(#.*)$", 1)
    pairs = F.filter(F.split(F.regexp_extract(base, r"\?(.*)$", 1), "&"), lambda p: (p != "") & (F.substring_index(p, "=", 1) != "dl"))
    dropbox = F.concat(F.substring_index(base, "?", 1), F.lit("?"), F.array_join(F.concat(pairs, F.array(F.lit("dl=1"))), "&"), fragment)
    in_path, in_query = F.regexp_extract(url, r"/d/([A-Za-z0-9_-]{10,})", 1), F.regexp_extract(url, r"[?&]id=([A-Za-z0-9_-]{10,})", 1)
    file_id = F.coalesce(F.nullif(in_path, F.lit("")), F.nullif(in_query, F.lit("")))
    return F.when(provider == "Dropbox", dropbox).when(provider == "Google Drive", F.concat(F.lit("https://drive.google.com/uc?export=download&id="), file_id))


def status_note(status: Column, provider: Column, url: Column) -> Column:
    """Why a link has no file, in words; empty where there is nothing to say."""
    # The notes.
    document = (provider == "Google Drive") & F.contains(F.coalesce(url, F.lit("")), F.lit("docs.google.com"))
    return (
        F.when(status == "needs-auth", "Sign-in required (private link). Open it yourself, or download the file and attach it.")
        .when((status == "dead") & document, "Google Doc — can't auto-download. Open it signed in and use File > Download, or share it as a file.")
        .when(status == "dead", "Link returned not-found / expired — the file may have been removed or the URL changed.")
        .when(status == "error", "Couldn't fetch this link (network or browser error) — it'll be retried next time.")
        .otherwise("")
    )


def harvest_summary(scanned: DataFrame, links: DataFrame) -> DataFrame:
    """One row: messages scanned, messages with links, links, and links by provider."""
    by = links.groupBy("provider").agg(F.count("*").alias("n"))
    each = by.agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "provider", "n"))), "|").alias("by_provider"), F.sum("n").alias("links"))
    return scanned.agg(F.count("*").alias("scanned")).crossJoin(links.agg(F.count_distinct("message_id").alias("with_links"))).crossJoin(each)  # one row each


def fetch_summary(links: DataFrame) -> DataFrame:
    """One row: links fetched, dead, in need of a sign-in, failed, and remaining (pending or failed), and how the phase went."""
    n = {s: F.count_if(F.col("status") == s) for s in ("downloaded", "dead", "needs-auth", "error", "pending")}
    out = links.agg(n["downloaded"].alias("downloaded"), n["dead"].alias("dead"), n["needs-auth"].alias("needs_auth"), n["error"].alias("failed"), (n["pending"] + n["error"]).alias("remaining"), F.count("*").alias("__n"))
    phase = F.when(F.col("__n") == 0, "skipped").when(F.col("remaining") > 0, F.concat_ws(" ", F.lit("partial:"), F.col("remaining"), F.lit("remaining"))).otherwise("ok")
    return out.withColumn("phase", phase).drop("__n")


def fetch_plan(links: DataFrame, order: str = "ordinal") -> tuple[DataFrame, DataFrame]:
    """Pending links that another record of their url settles, and the urls to fetch.

    ``links`` are ``message_id, url, provider, status, file, size, confirmed`` and an order (of several
    records the last counts). A file that some record has is used by all. A link that is not confirmed
    waits for it if the url is known to be too large, and else is dead or in need of a sign-in if
    another record found that. The first result is ``message_id, url, status, file, size, note``; the second
    is ``url, provider, confirmed, links``, one row a url, ``confirmed`` (any record is) lifting the bound of size.
    """
    last = lambda c, when: F.max_by(c, F.when(when, F.col(order)))
    has_file = (F.col("status") == "downloaded") & (F.coalesce("file", F.lit("")) != "")
    large = F.col("status") == "needs-confirm"
    known = links.where(F.col("status") != "pending").groupBy("url").agg(
        F.max(has_file).alias("__done"), last("file", has_file).alias("__file"), F.max(large).alias("__large"), last("size", large).alias("__size"),
        F.max(F.col("status") == "dead").alias("__dead"), F.max(F.col("status") == "needs-auth").alias("__auth"),
    )
    open_ = ~F.coalesce("confirmed", F.lit(False))
    told = F.when(F.col("__done"), "downloaded").when(open_ & F.col("__large"), "needs-confirm").when(open_ & F.col("__dead"), "dead").when(open_ & F.col("__auth"), "needs-auth")
    rows = links.where("status = 'pending'").join(known, "url", "left").withColumn("__told", told)
    settled = rows.where("__told is not null").select(
        "message_id", "url", F.col("__told").alias("status"), F.when(F.col("__told") == "downloaded", F.col("__file")).alias("file"), F.when(F.col("__told") == "needs-confirm", F.col("__size")).alias("size"),
        status_note(F.col("__told"), F.col("provider"), F.col("url")).alias("note"),
    )
    work = rows.where("__told is null").groupBy("url").agg(F.max_by("provider", order).alias("provider"), F.max(F.coalesce("confirmed", F.lit(False))).alias("confirmed"), F.count("*").alias("links"))
    return settled, work


def applied(links: DataFrame, settled: DataFrame) -> DataFrame:
    """``links`` with the status, file and size that ``fetch_plan`` settled, by message and url."""
    said = settled.dropDuplicates(["message_id", "url"]).select("message_id", "url", F.col("status").alias("__status"), F.col("file").alias("__file"), F.col("size").alias("__size"))
    rows = links.join(said, ["message_id", "url"], "left")
    own = lambda c: F.when((F.col("status") == "pending") & F.col("__status").isNotNull(), F.coalesce(f"__{c}", c)).otherwise(F.col(c)).alias(c)
    return rows.select(*(own(c) if c in ("status", "file", "size") else F.col(c) for c in links.columns))


def status_counts(links: DataFrame) -> DataFrame:
    """``status, n, providers``: links by status (null: pending), and the providers of each."""
    return links.groupBy(F.coalesce("status", F.lit("pending")).alias("status")).agg(F.count("*").alias("n"), F.array_sort(F.collect_set("provider")).alias("providers"))


def triage(links: DataFrame, order: str = "ordinal", most: int = 50) -> DataFrame:
    """``status, url, provider``: the first ``most`` links in need of a sign-in, and as many dead ones."""
    first = lambda s: links.where(F.col("status") == s).orderBy(order).limit(most).select("status", "url", "provider")
    return first("needs-auth").unionAll(first("dead"))


def to_confirm(links: DataFrame) -> DataFrame:
    """``message_id, url, provider, gb`` of every link that waits for a word because of its size."""
    return links.where("status = 'needs-confirm'").select("message_id", "url", F.coalesce("provider", F.lit("")).alias("provider"), F.bround(F.coalesce("size", F.lit(0)) / 1073741824, 2).alias("gb"))


def thread_links(links: DataFrame, members: DataFrame) -> DataFrame:
    """``thread_id, total, fetched, pending`` of links that stand in a member, by its id, else by its path (either slash); waiting for a sign-in or a word is pending too."""
    path = lambda c: F.replace(F.coalesce(c, F.lit("")), F.lit("\\"), F.lit("/"))
    by_id = members.where("message_id <> ''").groupBy(F.array("message_id").alias("__id")).agg(F.max("thread_id").alias("__by_id"))
    by_path = members.where("path <> ''").groupBy(path("path").alias("__path")).agg(F.max("thread_id").alias("__by_path"))
    # a link without an id gets a longer key of its own, which no member has: in the join by id such links would meet in one task
    own = F.array(F.lit(""), F.monotonically_increasing_id().cast("string"))
    key = F.when(F.coalesce("message_id", F.lit("")) == "", own).otherwise(F.array("message_id"))
    rows = links.withColumn("__path", path("path")).withColumn("__id", key).join(by_id, "__id", "left")
    found, rest = rows.where("__by_id is not null").select("status", F.col("__by_id").alias("thread_id")), rows.where("__by_id is null and __path <> ''")
    found = found.unionAll(rest.join(by_path, "__path").select("status", F.col("__by_path").alias("thread_id")))
    waits = F.coalesce("status", F.lit("pending")).isin("pending", "needs-auth", "needs-confirm")
    return found.groupBy("thread_id").agg(F.count("*").alias("total"), F.count_if(F.col("status") == "downloaded").alias("fetched"), F.count_if(waits).alias("pending"))
