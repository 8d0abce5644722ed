"""Message fields: ids, subjects, dates, file names, quoted replies, signatures."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from missiva.functions.steps import once

# Reply prefixes, and lines that begin quoted text, close a letter, or are no signature.
PREFIXES = "re|fwd|fw|aw|sv|antw"
QUOTE_STARTS = (
    r"\s*>",
    r"\s*On\s.{0,200}\bwrote:\s*$",
    r"\s*-{2,}\s*original\smessage\s*-{2,}",
    r"\s*_{5,}\s*$",
    r"\s*(?:from|发件人|de|von|van)\s*[:：]\s.{0,200}$",
    r"\s*(?:sent|发送时间|date)\s*[:：]\s.{0,120}$",
)
SIGN_OFFS = (
    r"best\s+regards", r"warm(?:est)?\s+regards", r"kind\s+regards", r"with\s+(?:kind\s+)?regards", "regards", "rgds", r"thanks?(?:\s*(?:&|and)\s*regards)?", r"thank\s+you", "sincerely",
    r"yours\s+\w+", "cheers", r"b\.?\s*r\.?", r"with\s+thanks",
)
NO_SIGNATURE = (
    "confidential", r"in\s+error", r"please\s+notify", r"intended\s+(?:solely\s+)?(?:for|recipient|only)", "privileged", r"all\s+rights\s+reserved", "unsubscribe", "disclaimer",
    r"do\s+not\s+(?:copy|disclose)", r"this\s+(?:e-?mail|message|communication)",
)
SALUTATIONS, FOOTERS = ("dear", "hi", "hello", "attn", "to"), ("©", "&copy;", r"\bcopyright\b", r"\bsent\s+from\s+my\b")

QUOTE_START = f"(?iu)^(?:{'|'.join(QUOTE_STARTS)})"
SIGN_OFF = rf"(?iU)^\s*(?:{'|'.join(SIGN_OFFS)})\b[\s,.!-]*$"
SKIPPED = rf"(?iU)\b(?:{'|'.join(NO_SIGNATURE)})\b|^\s*(?:{'|'.join(SALUTATIONS)})\b|{'|'.join(FOOTERS)}"


def clean_subject(subject: Column) -> Column:
    """Subject without reply prefixes; "(no subject)" if nothing is left."""
    bare = F.trim(F.regexp_replace(F.coalesce(subject, F.lit("")), rf"(?i)^(?:\s*(?:{PREFIXES})\s*:\s*)+", ""))
    return F.when(bare == "", "(no subject)").otherwise(bare)


def header_ids(value: Column) -> Column:
    """Ids in angle brackets, lower-cased."""
    return F.transform(F.regexp_extract_all(F.coalesce(value, F.lit("")), F.lit("<([^>]+)>"), F.lit(1)), lambda x: F.lower(F.trim(x)))


# Named zones of mail dates.
ZONES = {"GMT": "+0000", "UT": "+0000", "UTC": "+0000", "Z": "+0000", "EST": "-0500", "EDT": "-0400", "CST": "-0600", "CDT": "-0500", "MST": "-0700", "MDT": "-0600", "PST": "-0800", "PDT": "-0700"}


def to_utc(date: Column) -> Column:
    """RFC 2822 date as UTC ISO string; seconds may be missing, without a zone it is UTC, unreadable ones are null."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(date, r"^\s*[A-Za-z]{3},\s*", ""), r"\s*\([^)]*\)\s*$", ""))
    parts = r"^(\d{1,2}) +([A-Za-z]{3}) +(\d{4}) +(\d{1,2}):(\d\d)(?::(\d\d))? *([+-]\d{4}|[A-Za-z]{1,4})?$"
    g = lambda k: F.regexp_extract(bare, parts, k)
    named = F.create_map(*(F.lit(x) for kv in ZONES.items() for x in kv))
    zone = F.when(g(7).rlike(r"^[+-]"), g(7)).otherwise(F.coalesce(F.try_element_at(named, F.upper(g(7))), F.lit("+0000")))
    second = F.when(g(6) == "", "00").otherwise(g(6))
    at = F.concat(g(1), F.lit(" "), F.initcap(g(2)), F.lit(" "), g(3), F.lit(" "), F.lpad(g(4), 2, "0"), F.lit(":"), g(5), F.lit(":"), second, F.lit(" "), zone)
    return F.date_format(F.try_to_timestamp(at, F.lit("d MMM yyyy HH:mm:ss Z")), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def safe_name(name: Column, most: int = 60) -> Column:
    """ASCII file stem: letters, digits, dot, dash; runs of others become one underscore."""
    return F.substring(F.trim(F.regexp_replace(F.coalesce(name, F.lit("")), r"[^A-Za-z0-9.-]+", "_"), F.lit("_.")), 1, most)


def folder_path(folder: Column) -> Column:
    """Folder name split at either slash, each part made safe."""
    return F.array_join(F.filter(F.transform(F.split(F.coalesce(folder, F.lit("")), r"[/\\]"), lambda x: safe_name(x)), lambda x: x != ""), "/")


def own_text(body: Column) -> Column:
    """Lines above the first line that begins a quoted reply."""
    def own(lines: Column) -> Column:
        first = F.array_position(F.transform(lines, lambda x: x.rlike(QUOTE_START)), F.lit(True))
        return once(first, lambda n: F.array_join(F.when(n > 0, F.slice(lines, F.lit(1), (n - 1).cast("int"))).otherwise(lines), "\n"))

    return once(F.split(F.coalesce(body, F.lit("")), r"\r?\n"), own)


def signature_zone(body: Column, most: int = 12) -> Column:
    """Lines after the last sign-off of the own text, else its last ten that are not blank, as a signature shows them.

    List and quote marks at the edges go, and so do blank lines, salutations, disclaimers and footers;
    the first ``most`` lines are left.
    """
    lines = F.filter(F.split(own_text(body), "\n"), lambda x: F.trim(F.regexp_replace(x, r"\s+", " ")) != "")

    def last(lines: Column) -> Column:
        n, place = F.size(lines), F.array_position(F.transform(F.reverse(lines), lambda x: x.rlike(SIGN_OFF)), F.lit(True))
        return once(place, lambda p: F.slice(lines, F.when(p > 0, n - p + 2).otherwise(F.greatest(F.lit(1), n - 9)).cast("int"), n))

    bare = F.transform(once(lines, last), lambda x: F.trim(F.trim(F.trim(F.regexp_replace(F.regexp_replace(x, r"^[>*_|\-\s]+", ""), r"\s+$", "")), F.lit("*_"))))
    return F.slice(F.filter(bare, lambda x: (x != "") & ~x.rlike(SKIPPED)), F.lit(1), F.lit(most))


def pack_messages(lengths: Column, most: int) -> Column:
    """Chunk number of each message when consecutive messages are packed greedily up to ``most`` characters."""
    start = F.struct(F.lit(1).alias("chunk"), F.lit(0).cast("long").alias("used"), F.array().cast("array<int>").alias("out"))

    def step(acc: Column, n: Column) -> Column:
        full = (acc["used"] > 0) & (acc["used"] + n > most)
        chunk = F.when(full, acc["chunk"] + 1).otherwise(acc["chunk"])
        return F.struct(chunk.alias("chunk"), F.when(full, n).otherwise(acc["used"] + n).cast("long").alias("used"), F.array_append(acc["out"], chunk).alias("out"))

    return F.aggregate(lengths, start, step, lambda acc: acc["out"])
