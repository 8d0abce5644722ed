"""Records assembled from model output: tolerant JSON, ledgers, facts, actions, consensus, coverage, review.

Everything but the repair of cut-off JSON is a native column expression; the repair sees only the
rows whose text does not parse. Null text counts as empty throughout.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from missiva.functions import atoms, deadlines
from missiva.functions.steps import once

ITEM = "struct<id:string,matter:string,item:string,desc:string,title:string,status:string,owner:string,supersedes:string>"
CITED = "struct<field:string,value:string,cite:string>"
CONTACT = "struct<name:string,position:string,company:string,phone:string,email:string,cite:string>"
OWNED = "array<struct<owner:string,source:string>>"
ACTION = (
    "struct<action:string,about:string,owner:string,counterparty:string,direction:string,is_mine:boolean,due_raw:string,status:string,priority:string,"
    f"confidence:string,source:string,quote:string,refs:array<string>,false_positive_suspected:boolean,implied:boolean,owner_history:{OWNED}>"
)
# Statuses of actions, of closed ledger items, words that do not name an event.
STATUSES = ("open", "done", "blocked", "superseded", "partial")
CLOSED = ("done", "closed", "resolved", "superseded", "cancelled")
NOT_EVENTS = (
    "the", "a", "an", "after", "before", "from", "prior", "to", "following", "of", "day", "days", "week", "weeks", "month", "months",
    "business", "working", "within", "net",
)
# A model's remark after a value, a weekday before a date, a number, a message tag.
REMARK, LEADING_DAY, NUMBER, TAG = r"\s+(?:[—–;(]|-\s).*$", r"(?i)^(?:mon|tue|wed|thu|fri|sat|sun)[a-z]*[,.\s]+", r"\d[\d,]*\.?\d*", r"[Mm]\d+"

_text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
_strip = lambda c: F.regexp_replace(_text(c), r"(?U)^\s+|\s+$", "")
_empty = lambda kind="array<string>": F.array().cast(kind)


def normal(text: Column) -> Column:
    """Lower case, single blanks."""
    return F.trim(F.regexp_replace(F.lower(_text(text)), r"(?U)\s+", " "))


# --- JSON ----------------------------------------------------------------------------------------


_TOKEN = re.compile(r'[ \t\n\r]*(?:("(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*")|([{}\[\],:])|(-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?|true|false|null|NaN|-?Infinity))')
_ENDS, _STRAY = re.compile(r"[ \t\n\r]*(?:[,}\]]|\Z)"), re.compile(r"\s*(?:,|[,:]*\s*\Z)")
#: Objects and lists within each other that are read.
DEEPEST = 500
# what may come next: a value, a value or the end of its list, a key, a key or the end of its object, a colon, a comma or an end
VALUE, FIRST, KEY, OPENED, COLON, AFTER = range(6)


def mend(text: str | None) -> str | None:
    """A JSON object that was cut off: the longest head that ends with a whole value and can be closed; null if there is none.

    One scan, whatever the length. An object or list that opens at the very end, or before a stray comma, counts as
    empty, numbers and words count if a delimiter or the end follows, and what comes after the object is left out.
    """
    at = begin = -1 if text is None else text.find("{")
    if begin < 0:
        return None
    state, closing, good, depth = VALUE, [], None, 0
    while m := _TOKEN.match(text, at):
        quoted, mark, plain = m.groups()
        at = m.end()
        if quoted and state in (KEY, OPENED):
            state = COLON
        elif (quoted and state in (VALUE, FIRST)) or (plain and state in (VALUE, FIRST) and _ENDS.match(text, at)):
            state, good, depth = AFTER, at, len(closing)
        elif mark in ("{", "[") and state in (VALUE, FIRST) and len(closing) < DEEPEST:
            closing.append("}" if mark == "{" else "]")
            state = OPENED if mark == "{" else FIRST
            if _STRAY.match(text, at):
                good, depth = at, len(closing)
        elif mark in ("}", "]") and state in (AFTER, OPENED if mark == "}" else FIRST) and mark == closing[-1]:
            closing.pop()
            state, good, depth = AFTER, at, len(closing)
            if not closing:
                break
        elif mark == "," and state == AFTER:
            state = KEY if closing[-1] == "}" else VALUE
        elif mark == ":" and state == COLON:
            state = VALUE
        else:
            break
    # what is closed is always a whole value, so what was open at the last good place is still open
    return None if good is None else text[begin:good] + "".join(reversed(closing[:depth]))


def parse_objects(rows: DataFrame, text: str, out: str = "json") -> DataFrame:
    """``rows`` with the JSON in a model's answer: the answer itself without code fences, the block in braces, or a mended cut-off object.

    Null if nothing can be saved. Rows whose answer parses reach the Python workers as nulls only.
    """
    fenced = lambda t: _strip(F.regexp_replace(t, r"^```[a-zA-Z]*\n?|\n?```$", ""))
    bare = once(_strip(F.col(text)), lambda t: F.when(F.startswith(t, F.lit("```")), fenced(t)).otherwise(t))
    valid = lambda c: (c != "") & F.try_parse_json(c).isNotNull()

    def read(b: Column) -> Column:
        found = F.when(valid(b), b).otherwise(once(F.regexp_extract(b, r"(?s)\{.*\}", 0), lambda block: F.when(valid(block), block)))
        return once(found, lambda x: F.struct(x.alias("found"), F.when(x.isNull(), b).alias("rest")))

    staged = rows.withColumn("__read", once(bare, read)).withColumn("__found", F.col("__read.found")).withColumn("__rest", F.col("__read.rest")).drop("__read")

    @F.pandas_udf("string")
    def mended(texts: pd.Series) -> pd.Series:
        return texts.map(mend, na_action="ignore").astype(object)

    return staged.withColumn(out, F.coalesce("__found", mended("__rest"))).drop("__found", "__rest")


def split_ledger(text: Column) -> Column:
    """``{prose, ledger}`` of an answer with an open-items ledger between its marks; an empty ledger without them."""
    blob = F.regexp_extract(_text(text), r"(?s)<<<LEDGER>>>(.*?)(?:<<<END>>>|$)", 1)
    return F.struct(_strip(F.substring_index(_text(text), "<<<LEDGER>>>", 1)).alias("prose"), _strip(blob).alias("ledger"))


def ledger_items(text: Column) -> Column:
    """Open items of the ledger, whether it is an object with open_items (or items) or an array; empty if it does not parse."""
    blob = split_ledger(text)["ledger"]

    def good(b: Column) -> Column:
        block = F.regexp_extract(b, r"(?s)[\[{].*[\]}]", 0)
        return F.when(F.try_parse_json(b).isNotNull(), b).when(F.try_parse_json(block).isNotNull(), block)

    def parsed(g: Column) -> Column:
        boxed = once(F.from_json(g, f"struct<open_items:array<{ITEM}>,items:array<{ITEM}>>"), lambda x: F.when(F.size(x["open_items"]) > 0, x["open_items"]).otherwise(x["items"]))
        return F.when(F.startswith(g, F.lit("[")), F.from_json(g, f"array<{ITEM}>")).otherwise(boxed)

    items = once(blob, lambda b: once(good(b), parsed))
    return F.filter(F.coalesce(items, _empty(f"array<{ITEM}>")), lambda x: x.isNotNull())


def registrar_facts(answer: Column) -> Column:
    """``{project, parties, refs, dates, amounts, sources, contacts}`` of a facts answer: bare values by class, and what each was cited from.

    The first project counts; the others stay among the sources. Repeated values count once, in order.
    """
    tidy = lambda xs, field: F.filter(
        F.transform(F.coalesce(xs, _empty(f"array<{CITED}>")), lambda x: F.struct(field(x).alias("field"), _strip(x["value"]).alias("value"), _strip(x["cite"]).alias("cite"))), lambda x: x["value"] != ""
    )
    classes = {"parties": "party", "refs": "ref", "dates": "date", "amounts": "amount"}

    def listed(got: Column) -> Column:
        facts = F.filter(tidy(got["facts"], lambda x: F.lower(_strip(x["field"]))), lambda x: x["field"].isin(*classes.values()))
        return F.struct(tidy(got["project"], lambda _: F.lit("project")).alias("projects"), facts.alias("facts"), clean_contacts(got["contacts"]).alias("contacts"))

    def assembled(x: Column) -> Column:
        of = lambda name: F.array_distinct(F.transform(F.filter(x["facts"], lambda f: f["field"] == name), lambda f: f["value"]))
        first = F.coalesce(F.try_element_at(x["projects"], F.lit(1))["value"], F.lit(""))
        return F.struct(first.alias("project"), *(of(v).alias(k) for k, v in classes.items()), F.concat(x["projects"], x["facts"]).alias("sources"), x["contacts"].alias("contacts"))

    return once(once(F.from_json(answer, f"struct<project:array<{CITED}>,facts:array<{CITED}>,contacts:array<{CONTACT}>>"), listed), assembled)


def clean_contacts(contacts: Column) -> Column:
    """Contacts with trimmed fields; those without a name and an address go."""
    fields = ("name", "position", "company", "phone", "email")
    tidy = F.transform(F.coalesce(contacts, _empty(f"array<{CONTACT}>")), lambda x: F.struct(*(_strip(x[f]).alias(f) for f in fields), F.nullif(_strip(x["cite"]), F.lit("")).alias("cite")))
    return F.filter(tidy, lambda x: (x["name"] != "") | (x["email"] != ""))


# --- grounding -----------------------------------------------------------------------------------


def grounded(values: Column, source: Column, numeric: bool = False) -> Column:
    """``{kept, dropped}``: values whose core stands in the source (whole words; contained for other scripts), or whose numbers of three digits and more all do."""
    digits = lambda s: F.transform(F.regexp_extract_all(s, F.lit(f"(?U){NUMBER}"), F.lit(0)), lambda x: F.regexp_replace(x, r"(?U)\D", ""))

    def core(v: Column) -> Column:
        tidy = lambda s: F.trim(F.regexp_replace(F.regexp_replace(s, f"(?sU){REMARK}", ""), f"(?U){LEADING_DAY}", ""))
        return once(_strip(v), lambda s: F.coalesce(F.nullif(tidy(s), F.lit("")), s))

    def holds(v: Column, c: Column, src: Column, known: Column) -> Column:
        whole = F.regexp_like(src, F.concat(F.lit(r"(?U)\b\Q"), F.replace(c, F.lit(r"\E")), F.lit(r"\E\b")))
        # what the source does not contain it does not hold as a whole word either
        ok = (c != "") & F.contains(src, c) & (c.rlike(r"[^\x00-\x7F]") | whole)
        if numeric:
            nums = F.filter(digits(_strip(v)), lambda n: F.char_length(n) >= 3)
            ok = ok | once(nums, lambda ns: (F.size(ns) > 0) & F.forall(ns, lambda n: F.array_contains(known, n)))
        return ok

    def judged(x: Column) -> Column:
        cores = F.transform(F.filter(F.coalesce(values, _empty()), lambda v: v.isNotNull()), lambda v: F.struct(v.alias("v"), core(v).alias("core")))
        return F.transform(F.transform(cores, lambda t: F.struct(t["v"].alias("v"), t["core"].alias("core"), normal(t["core"]).alias("low"))),
                           lambda t: F.struct(t["v"].alias("v"), t["core"].alias("core"), holds(t["v"], t["low"], x["src"], x["known"]).alias("ok")))

    def split(all_values: Column) -> Column:
        kept = F.transform(F.filter(all_values, lambda t: t["ok"]), lambda t: t["core"])
        return F.struct(F.array_distinct(kept).alias("kept"), F.transform(F.filter(all_values, lambda t: ~t["ok"] & (t["v"] != "")), lambda t: t["v"]).alias("dropped"))

    read = once(normal(source), lambda src: F.struct(src.alias("src"), (digits(src) if numeric else _empty()).alias("known")))
    return once(once(read, judged), split)


def backfill(found: Column, floor: Column, amounts: bool = False) -> Column:
    """The values that a rule finds and the model left out, to be appended; an amount only if no known amount has its digits."""
    missing = F.array_except(F.coalesce(floor, _empty()), F.coalesce(found, _empty()))
    if not amounts:
        return missing
    known = F.transform(F.coalesce(found, _empty()), lambda x: F.regexp_replace(x, r"\D", ""))
    return F.filter(missing, lambda x: ~F.array_contains(known, F.regexp_replace(x, r"\D", "")))


def quote_unverified(quote: Column, source: Column) -> Column:
    """Is a leg of the quote (legs stand between double bars) missing from a source that has any text?"""
    legs = F.filter(F.transform(F.split(_text(quote), r"\|\|"), normal), lambda x: x != "")
    return once(normal(source), lambda src: (src != "") & F.exists(legs, lambda x: ~F.contains(src, x)))


def names_operator(operator: Column, text: Column) -> Column:
    """Does any of the operator's names (between commas, semicolons or line ends, of two characters or more) stand in the text as a whole token?"""
    tokens = F.filter(F.transform(F.split(F.lower(_text(operator)), r"[,;\n]+"), lambda x: F.trim(x)), lambda x: F.char_length(x) >= 2)
    whole = lambda t, x: F.contains(t, x) & F.regexp_like(t, F.concat(F.lit(r"(?U)(?<![\w.@-])\Q"), F.replace(x, F.lit(r"\E")), F.lit(r"\E(?![\w.@-])")))
    return once(F.lower(_text(text)), lambda t: F.exists(tokens, lambda x: whole(t, x)))


def tags(source: Column, valid: Column | None = None) -> Column:
    """Message tags in a citation, in upper case; with ``valid`` (tags of the messages there are, if any) only those."""
    found = F.transform(F.regexp_extract_all(_text(source), F.lit(TAG), F.lit(0)), F.upper)
    return found if valid is None else F.when(F.size(valid) > 0, F.filter(found, lambda t: F.array_contains(valid, t))).otherwise(found)


def facet_tags(given: Column, facets: Mapping[str, Sequence[str]]) -> Column:
    """Given 'Facet: value' tags that the vocabulary has, as it writes them, each once."""
    known = {f"{f}:{v}".lower(): f"{f}: {v}" for f, values in facets.items() for v in values}
    key = lambda t: F.lower(F.concat(F.trim(F.substring_index(t, ":", 1)), F.lit(":"), F.trim(F.regexp_extract(t, "(?s)^[^:]*:(.*)$", 1))))
    return F.array_distinct(F.array_compact(F.transform(F.coalesce(given, _empty()), lambda t: atoms.lookup(key(t), known, F.lit(None)))))


# --- due dates -----------------------------------------------------------------------------------


def year_less(text: Column, anchor: Column) -> Column:
    """ISO date of a day and month without a year, the year being the anchor's; null if there is none."""
    months = {m: i + 1 for i, m in enumerate(atoms.MONTHS)} | {m: i + 1 for i, m in enumerate(atoms.MONTH_NAMES)} | {"sept": 9}
    tries = []
    for pattern, day, month in ((r"\b(\d{1,2})\s+([A-Za-z]{3,9})\b", 1, 2), (r"\b([A-Za-z]{3,9})\s+(\d{1,2})\b", 2, 1)):
        part = lambda k, p=pattern: F.regexp_extract(_text(text), f"(?U){p}", k)
        number = atoms.lookup(F.lower(part(month)), months, F.lit(None)).cast("string")
        tries.append(F.when(F.length(_text(anchor)) >= 4, F.concat_ws("-", F.substring(anchor, 1, 4), number, part(day))).try_cast("date"))
        tries[-1] = F.when(number.isNotNull() & (part(day) != ""), tries[-1])
    return F.coalesce(*tries).cast("string")


def event_date(comprehension: Column, anchor: Column) -> Column:
    """Date of a named event: the first on a line that mentions it, else the only date of the whole text; null if neither."""
    words = F.filter(F.regexp_extract_all(F.lower(_text(anchor)), F.lit("[a-z一-鿿]{2,}"), F.lit(0)), lambda w: ~w.isin(*NOT_EVENTS))
    lines = once(words, lambda ws: F.filter(F.split(_text(comprehension), r"\r\n|\n|\r"), lambda line: F.exists(ws, lambda w: F.contains(F.lower(line), w))))

    def found(x: Column) -> Column:
        dated = F.filter(F.transform(x, atoms.extract_dates), lambda ds: F.size(ds) > 0)
        only = once(atoms.extract_dates(comprehension), lambda every: F.when(F.size(every) == 1, F.try_element_at(every, F.lit(1))))
        return once(dated, lambda d: F.when(F.size(d) > 0, F.try_element_at(F.try_element_at(d, F.lit(1)), F.lit(1))).when(F.size(x) > 0, only))

    return once(lines, found)


def due_date(rows: DataFrame, due_raw: str, anchor: str, comprehension: str, holidays: Sequence[str] = ()) -> DataFrame:
    """``rows`` with ``due_canonical, due_pending, due_basis``.

    A date in the text wins; then a relative deadline - from a named event or an invoice only if its
    date is stated in the comprehension, else from the citing message's date; then a date without a
    year; then a colloquial one. A deadline whose anchor is missing is pending.
    """
    raw = F.col(due_raw)
    staged = rows.withColumn("__iso", F.try_element_at(atoms.extract_dates(raw), F.lit(1))).withColumn("__rel", F.try_element_at(deadlines.find_deadlines(raw), F.lit(1)))
    kind, rel = F.col("__rel.kind"), F.col("__rel")
    event = F.when(kind == "relative", event_date(F.col(comprehension), F.col("__rel.anchor"))).when(kind == "net", event_date(F.col(comprehension), F.lit("invoice receipt dated issued")))
    staged = staged.withColumn("__event", F.when(F.col("__iso").isNull(), event)).withColumn("__at", F.nullif(_text(F.col(anchor)), F.lit("")).try_cast("date"))
    by_event = deadlines.resolve(rel["n"], rel["unit"], rel["direction"], F.col("__event").try_cast("date"))
    by_message = deadlines.resolve(rel["n"], rel["unit"], rel["direction"], F.col("__at"), holidays)
    staged = staged.withColumn("__due", F.when(kind.isin("relative", "net"), by_event).otherwise(by_message).cast("string"))
    staged = staged.withColumn("__year_less", year_less(raw, F.col(anchor))).withColumn("__said", deadlines.resolve_colloquial(raw, F.col("__at")).cast("string"))
    due, business = F.col("__due"), rel["unit"] == "businessdays"
    none, unsure = F.lit(""), "business-day estimate (holidays not applied — verify)"
    missing = F.concat(F.lit("anchor date not in thread — verify ("), F.coalesce(F.nullif(rel["anchor"], F.lit("")), F.lit("event")), F.lit(")"))
    basis = (
        F.when(F.col("__iso").isNotNull(), none)
        .when((kind == "relative") & F.col("__event").isNull(), missing)
        .when((kind == "net") & F.col("__event").isNull(), "Net-term — confirm invoice date")
        .when(kind.isNotNull() & due.isNull(), none)
        .when(kind == "relative", "event-anchored (verify the anchor date)")
        .when(kind == "net", "Net-term from invoice date (verify)")
        .when(kind.isNotNull() & business, "business-day (holiday calendar applied)" if holidays else unsure)
        .when(kind.isNotNull(), none)
        .when(F.col("__year_less").isNotNull(), "year inferred from message date")
        .when(F.col("__said").isNotNull(), "resolved vs message date")
        .otherwise(none)
    )
    pending = F.col("__iso").isNull() & kind.isNotNull() & (due.isNull() | (business & ~kind.isin("relative", "net") & F.lit(not holidays)))
    canonical = F.coalesce("__iso", F.when(kind.isNotNull(), due).otherwise(F.coalesce("__year_less", "__said")), none)
    return staged.withColumns({"due_canonical": canonical, "due_pending": pending, "due_basis": basis}).drop("__iso", "__rel", "__event", "__at", "__due", "__year_less", "__said")


# --- actions -------------------------------------------------------------------------------------


def clean_actions(rows: DataFrame, holidays: Sequence[str] = ()) -> DataFrame:
    """One row per action of a thread's answer, normalised and resolved.

    ``rows`` has ``actions`` (array of the struct ACTION), ``dates`` (map from message tags to dates),
    ``operator``, ``comprehension`` and ``source_text``; all its columns but ``actions`` stay. Actions
    without text go. Citations beyond the messages there are, and quotes that neither text holds, turn
    the confidence to review, and so does an end state without a citation. Statuses are clamped to
    the known ones. The operator's side is settled if exactly one party names the operator. A
    deadline that waits for its anchor raises the priority.
    """
    keep = [F.col(c) for c in rows.columns if c != "actions"]
    flat = rows.select(*keep, F.posexplode("actions").alias("action_no", "__a")).where(_strip(F.col("__a.action")) != "")
    a, valid = F.col("__a"), F.map_keys("dates")
    raw_tags, low = tags(a["source"]), lambda f, default: F.coalesce(F.nullif(F.lower(_strip(a[f])), F.lit("")), F.lit(default))
    texts = F.concat_ws(" ", "comprehension", "source_text")
    flat = flat.withColumns({
        **{f: _strip(a[f]) for f in ("action", "about", "counterparty", "due_raw", "quote")}, "owner": F.coalesce(F.nullif(_strip(a["owner"]), F.lit("")), F.lit("unclear")),
        "source": tags(a["source"], valid), "quote_unverified": quote_unverified(a["quote"], texts), "recurrence": deadlines.recurrence(F.concat_ws(" ", a["action"], a["due_raw"])),
        "__priority": low("priority", "normal"), "__status": low("status", "open"), "__confidence": low("confidence", "review"),
        "__mine": names_operator(F.col("operator"), F.coalesce(F.nullif(_strip(a["owner"]), F.lit("")), F.lit("unclear"))), "__theirs": names_operator(F.col("operator"), a["counterparty"]),
    })
    flat = flat.withColumn("__anchor", F.coalesce(F.try_element_at(F.filter(F.transform("source", lambda t: F.try_element_at("dates", t)), lambda d: F.coalesce(d, F.lit("")) != ""), F.lit(1)), F.lit("")))
    flat = due_date(flat, "due_raw", "__anchor", "comprehension", holidays)
    mine, theirs = F.col("__mine") & ~F.col("__theirs"), F.col("__theirs") & ~F.col("__mine")
    status = F.when(F.col("__status").isin(*STATUSES), F.col("__status")).otherwise("open")
    doubtful = (F.size("source") < F.size(raw_tags)) | F.col("quote_unverified") | (status.isin("done", "superseded") & (F.size("source") == 0))
    waiting = F.col("due_pending") & F.col("due_basis").rlike("anchor|confirm invoice")
    history = F.filter(F.coalesce(a["owner_history"], _empty(OWNED)), lambda h: _strip(h["owner"]) != "")
    return flat.select(
        *keep, "action_no", "action", "about", "owner", "counterparty",
        F.when(mine, "inbound").when(theirs, "outbound").otherwise(F.lower(_strip(a["direction"]))).alias("direction"), F.when(mine, True).when(theirs, False).otherwise(a["is_mine"]).alias("is_mine"),
        "due_raw", "due_canonical", "due_pending", "due_basis", "recurrence", F.filter(F.transform(F.coalesce(a["refs"], _empty()), _strip), lambda r: r != "").alias("refs"),
        status.alias("status"), F.when(waiting, "high").otherwise(F.col("__priority")).alias("priority"), "source", "quote", "quote_unverified",
        F.when(doubtful, "review").otherwise(F.col("__confidence")).alias("confidence"), F.coalesce(a["false_positive_suspected"], F.lit(False)).alias("false_positive_suspected"),
        F.coalesce(a["implied"], F.lit(False)).alias("implied"),
        F.transform(history, lambda h: F.struct(_strip(h["owner"]).alias("owner"), F.array_join(tags(h["source"], valid), ",").alias("source"))).alias("owner_history"),
    )


def implied_action(text: Column) -> Column:
    """A provisional action for a duty that a rule found: its text, and the date after the last words `— by`."""

    def told(t: Column, due: Column, iso: Column) -> Column:
        return F.struct(
            F.trim(F.substring_index(t, " — by ", 1)).alias("action"), F.lit("implied obligation — review").alias("about"), due.alias("due_raw"), iso.alias("due_canonical"),
            F.when(iso != "", "implied-floor").otherwise("").alias("due_basis"), F.lit("open").alias("status"), F.lit("review").alias("confidence"), F.lit(True).alias("implied"),
        )

    due = lambda t: F.trim(F.regexp_extract(t, "(?s)^.*? — by (.*)$", 1))
    return once(text, lambda t: once(due(t), lambda d: once(F.when(d.rlike(r"^\d{4}-\d\d-\d\d$"), d).otherwise(""), lambda iso: told(t, d, iso))))


def haystack(actions: Column) -> Column:
    """The words of a thread's actions and their references, for coverage tests."""
    said = F.transform(actions, lambda a: F.concat_ws(" ", a["action"], a["about"], a["quote"], F.array_join(F.coalesce(a["refs"], _empty()), " ")))
    return F.lower(F.array_join(F.coalesce(said, _empty()), " "))


def _covered(text: Column, more: Column, hay: Column, digits: int) -> Column:
    """``{covered, judged}``: is a text covered by a shared reference or two shared long words; has it any of them?

    References are looked for only where they can matter: they all hold a hyphen and a digit.
    """
    refs = F.transform(atoms.extract_refs(F.concat_ws(" ", text, more), digits), F.lower)
    words = F.array_distinct(F.concat(F.regexp_extract_all(F.lower(text), F.lit("[a-z]{5,}"), F.lit(0)), F.regexp_extract_all(text, F.lit("[一-鿿]{2,}"), F.lit(0))))
    told = lambda covered, judged: F.struct(covered.alias("covered"), judged.alias("judged"))
    held = lambda x: F.contains(hay, x)
    numbered = F.coalesce(hay.rlike(r"(?U)-\d"), F.lit(True))

    def judge(w: Column) -> Column:
        by_refs = once(refs, lambda r: told(F.exists(r, held), (F.size(r) > 0) | (F.size(w) > 0)))
        shared = F.size(F.filter(w, held)) >= 2
        return F.when(shared, told(F.lit(True), F.lit(True))).when((F.size(w) > 0) & ~numbered, told(F.lit(False), F.lit(True))).otherwise(by_refs)

    return once(words, judge)


def uncovered(candidates: Column, hay: Column, cues: Sequence[str] = ("request", "obligation", "waiver"), most: int = 10, digits: int = atoms.REFERENCE_DIGITS) -> Column:
    """Texts of the candidates with such a cue that no action covers, at most ``most``, in order."""
    asked = F.filter(candidates, lambda c: F.arrays_overlap(c["cues"], F.array(*map(F.lit, cues))))

    def open_(c: Column) -> Column:
        return once(_covered(c["text"], F.lit(""), hay, digits), lambda x: x["judged"] & ~x["covered"])

    return F.slice(F.transform(F.filter(asked, open_), lambda c: c["text"]), 1, most)


def unreconciled(items: Column, hay: Column, most: int = 10, digits: int = atoms.REFERENCE_DIGITS) -> Column:
    """Open ledger items that no action covers, at most ``most``, in order."""
    matter = lambda x: F.coalesce(*(F.nullif(_strip(x[f]), F.lit("")) for f in ("matter", "item", "desc", "title")), F.lit(""))

    def open_(x: Column) -> Column:
        live = ~F.lower(F.coalesce(F.nullif(x["status"], F.lit("")), F.lit("open"))).isin(*CLOSED)
        return live & once(matter(x), lambda m: once(_covered(m, _strip(x["id"]), hay, digits), lambda c: c["judged"] & ~c["covered"]))

    return F.slice(F.transform(F.filter(items, open_), lambda x: F.coalesce(F.nullif(matter(x), F.lit("")), _strip(x["id"]))), 1, most)


# --- consensus and review ------------------------------------------------------------------------


def precedence(text: Column, rules: Sequence[tuple[Sequence[str], str]]) -> Column:
    """Category of the first rule of which a word or phrase stands in the text; null if none does."""
    quote = lambda w: "".join("\\" + c if c in r"\.-[](){}*+?|^$" else c for c in w.strip().lower())
    return F.coalesce(*(F.when(F.lower(_text(text)).rlike(r"(?U)\b(?:" + "|".join(map(quote, words)) + r")\b"), F.lit(then)) for words, then in rules), F.lit(None).cast("string"))


def classify(small: Column, full: Column, text: Column, taxonomy: Mapping[str, Sequence[str]], rules: Sequence[tuple[Sequence[str], str]] = ()) -> Column:
    """``{domain, category, confidence, council, consensus}`` from the answers of a small and a full council.

    The small council's word stands unless it is disputed, under 0.6 sure, or no pair of the taxonomy.
    Then the full council's counts, a precedence rule overrules its category, and an answer under 0.5
    or outside the taxonomy is put to the operator.
    """
    pairs = F.array(*(F.lit(f"{d}\n{c}") for d, cs in taxonomy.items() for c in cs))
    known = lambda d, c: F.array_contains(pairs, F.concat_ws("\n", d, c))
    given = lambda c, default: F.coalesce(F.nullif(c, F.lit("")), default)
    domain, category, sure = given(small["domain"], F.lit(next(iter(taxonomy)))), _text(small["category"]), F.coalesce(small["confidence"].cast("double"), F.lit(0.0))
    settled = ~F.coalesce(small["dispute"], F.lit(False)) & (sure >= 0.6) & known(domain, category)
    domain2, voted, sure2 = given(full["domain"], domain), given(full["category"], category), F.coalesce(full["confidence"].cast("double"), sure)
    ruled = precedence(text, rules)
    category2 = F.coalesce(ruled, voted)
    consensus = F.when((sure2 < 0.5) | ~known(domain2, category2), "asked").when(ruled.isNotNull() & (ruled != voted), "split-resolved").otherwise("majority")
    pick = lambda a, b, name: F.when(settled, a).otherwise(b).alias(name)
    return F.struct(
        pick(domain, domain2, "domain"), pick(category, category2, "category"), pick(sure, sure2, "confidence"), pick(F.lit("small"), F.lit("full"), "council"), pick(F.lit("unanimous"), consensus, "consensus")
    )


def issue_text(issue: Column) -> Column:
    """One line of a finding ``{target, type, detail, evidence}``."""
    head = F.concat_ws(" ", F.nullif(issue["target"], F.lit("")), F.nullif(issue["type"], F.lit("")))
    return F.concat_ws(" — ", *(F.nullif(x, F.lit("")) for x in (head, _strip(issue["detail"]), _strip(issue["evidence"]))))


def review_gate(passed: Column, checks: Sequence[Column], truncated: Column, lists: Mapping[str, Column], issues: Column, most: int = 8) -> Column:
    """``{needs_review, issues}``: any failed or missing check, truncation, or non-empty list asks for review.

    ``lists`` maps a message with ``{n}`` (its length) or ``{all}`` (its values) to an array.
    """
    ok = F.coalesce(passed, F.lit(False))
    for c in checks:
        ok = ok & F.coalesce(c, F.lit(False))
    cut, notes, any_list = F.coalesce(truncated, F.lit(False)), [], F.lit(False)
    for message, values in lists.items():
        xs = F.coalesce(values, _empty())
        line = F.replace(F.replace(F.lit(message), F.lit("{n}"), F.size(xs).cast("string")), F.lit("{all}"), F.array_join(xs, ", "))
        notes.append(F.when(F.size(xs) > 0, line))
        any_list = any_list | (F.size(xs) > 0)
    added = F.array_compact(F.array(F.when(cut, F.lit("input truncated")), *notes))
    return F.struct((~ok | cut | any_list).alias("needs_review"), F.slice(F.concat(F.coalesce(issues, _empty()), added), 1, most).alias("issues"))


def last_attempt(attempts: DataFrame, keys: Sequence[str], no: str = "attempt") -> DataFrame:
    """The last attempt at each record; ``flagged`` if none of them passed (column ``passed``)."""
    every = Window.partitionBy(*keys)
    ranked = attempts.withColumn("__k", F.row_number().over(every.orderBy(F.desc(no)))).withColumn("flagged", ~F.coalesce(F.max("passed").over(every), F.lit(False)))
    return ranked.where("__k = 1").drop("__k")


# --- long threads, model input -------------------------------------------------------------------


def stitch_chunks(chunks: DataFrame, keys: Sequence[str], no: str, text: str) -> DataFrame:
    """``keys, comprehension``: the prose of a thread's chunks in order, each later one up to its CURRENT STATE line, and the last chunk's ledger."""
    parts = split_ledger(F.col(text))
    body = F.when(F.col(no) > F.min(no).over(Window.partitionBy(*keys)), _strip(F.regexp_replace(parts["prose"], r"(?is)(?:^|(?<=\n))[ \t]*CURRENT STATE.*$", ""))).otherwise(parts["prose"])
    rows = chunks.select(*keys, F.col(no).alias("__no"), body.alias("__body"), parts["ledger"].alias("__ledger"))
    told = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("__no", "__body"))).alias("__all"), F.max_by("__ledger", "__no").alias("__ledger"))
    prose = _strip(F.array_join(F.transform("__all", lambda x: x["__body"]), "\n\n"))
    return told.select(*keys, F.when(F.col("__ledger") != "", F.concat(prose, F.lit("\n\n<<<LEDGER>>>\n"), F.col("__ledger"), F.lit("\n<<<END>>>"))).otherwise(prose).alias("comprehension"))


def cap_message(text: Column, limit: int = 48_000, part_limit: int = 8_000) -> Column:
    """A message for the model: each attachment or shared file cut to ``part_limit`` characters, then the whole to ``limit``, with a visible mark."""
    # a mark that no text holds splits the message before each section
    parts = F.split(F.regexp_replace(_text(text), r"(\n\n\[(?:attachment|shared file): [^\]]*\]\n)", "\u0000\u0000$1\u0000"), "\u0000\u0000")
    note, whole_note = "\n[… attachment truncated for the AI; the floor reads it in full …]", "\n[… message truncated to fit the comprehension budget …]"

    def section(p: Column, i: Column) -> Column:
        head, body = F.substring_index(p, "\u0000", 1), F.regexp_extract(p, "(?s)^[^\u0000]*\u0000(.*)$", 1)
        return F.when(i == 0, p).otherwise(F.concat(head, F.when(F.char_length(body) > part_limit, F.concat(F.substring(body, 1, part_limit), F.lit(note))).otherwise(body)))

    capped = F.array_join(F.transform(parts, section), "")
    return F.when(F.char_length(capped) > limit, F.concat(F.substring(capped, 1, limit), F.lit(whole_note))).otherwise(capped)


def candidate_sheet(candidates: Column) -> Column:
    """The candidates as the JSON list that a model's prompt takes."""
    return F.to_json(candidates)


def facet_vocabulary(facets: Mapping[str, Sequence[str]]) -> Column:
    """One line a facet with its values."""
    return F.lit("\n".join(f"{f}: {', '.join(v)}" for f, v in facets.items()) or "(no facets defined)")
