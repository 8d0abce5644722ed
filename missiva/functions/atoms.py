"""Extractors of references, dates, amounts, percentages, addresses and links, as native column expressions.

Patterns of numbers, dates, amounts, links and references, like the tables below, are fixed values: results must agree to the letter.
Every function maps a string column to an array (or struct of arrays) without Python UDFs. Null text
gives an empty array. Patterns start with (?U) so that classes cover full-width and CJK characters.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from missiva.functions.steps import once

# Prefixes that are not references, nouns that name one, months, currencies, multipliers.
NOT_REFERENCES = ("ISO", "COVID", "MP", "H", "CO", "SGD", "USD", "EUR", "GBP", "MYR", "RMB", "CNY", "RM", "US", "EU")
REFERENCE_NOUNS = (
    "invoice", "inv", "po", "rfi", "rfq", "rfp", "ncr", "cr", "eot", "vo", "co", "wo", "tq", "cvi", "mci", "soi", "ipc", "dwg", "drawing",
    "clause", "section", "ticket", "tender", "claim", "quotation", "contract", "ref", "version", "rev", "round", "job", "sprint",
)
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
MONTH_NAMES = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
CURRENCIES = {
    "$": "USD", "us$": "USD", "usd": "USD", "s$": "SGD", "sgd": "SGD", "€": "EUR", "eur": "EUR", "£": "GBP", "gbp": "GBP", "myr": "MYR", "rm": "MYR",
    "rmb": "CNY", "cny": "CNY", "¥": "CNY", "hk$": "HKD", "hkd": "HKD", "nt$": "TWD", "ntd": "TWD", "人民币": "CNY", "港币": "HKD", "新台币": "TWD", "新币": "SGD",
}
MULTIPLIERS = {"k": 1_000, "thousand": 1_000, "m": 1_000_000, "mn": 1_000_000, "million": 1_000_000, "bn": 1_000_000_000, "billion": 1_000_000_000, "千": 1_000, "万": 10_000, "亿": 100_000_000}
LINK_PROVIDERS = {
    "SharePoint/OneDrive": r"""https?://[^\s"'<>)]*(?:sharepoint\.com|1drv\.ms|onedrive\.live)[^\s"'<>)]*""",
    "Google Drive": r"""https?://(?:drive|docs)\.google\.com/[^\s"'<>)]+""",
    "Dropbox": r"""https?://[^\s"'<>)]*dropbox\.com/[^\s"'<>)]+""",
    "WeTransfer": r"""https?://(?:we\.tl|[^\s"'<>)]*wetransfer\.com)/[^\s"'<>)]+""",
    "Box": r"""https?://[^\s"'<>)]*box\.com/[^\s"'<>)]+""",
}


def _find(text: Column, pattern: str) -> Column:
    """All matches of a pattern, whole."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"(?U){pattern}"), F.lit(0))


def _group(match: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract(match, f"(?U){pattern}", group)


def _groups(text: Column, pattern: str, *numbers: int) -> Column:
    """``{g1, ...}`` of all matches of a pattern: those groups of each, worked out once."""
    return F.transform(_find(text, pattern), lambda m: F.struct(*(_group(m, pattern, k).alias(f"g{k}") for k in numbers)))


def lookup(key: Column, values: Mapping[str, object], default: Column) -> Column:
    """Value of a small fixed table."""
    table = F.create_map(*(F.lit(x) for kv in values.items() for x in kv))
    return F.coalesce(F.try_element_at(table, key), default)


def ascii_forms(text: Column) -> Column:
    """Full-width digits and punctuation as ASCII."""
    return F.when(F.octet_length(text) == F.char_length(text), text).otherwise(F.translate(F.coalesce(text, F.lit("")), "０１２３４５６７８９，．￥％", "0123456789,.¥%"))


def _reference(prefix: Column, number: Column, suffix: Column) -> Column:
    """PREFIX-N without leading zeros of the integer part, with a sub-part and a revision letter."""
    whole = F.regexp_replace(F.substring_index(number, ".", 1), r"^0+(?=\d)", "")
    part = F.when(F.contains(number, F.lit(".")), F.concat(F.lit("."), F.substring_index(number, ".", -1))).otherwise("")
    return F.concat(F.upper(prefix), F.lit("-"), whole, part, F.upper(suffix))


#: Digits of a reference's number, unless a caller's references are longer.
REFERENCE_DIGITS = 6


def extract_refs(text: Column, digits: int = REFERENCE_DIGITS) -> Column:
    """Canonical references in order of the four forms: codes, codes with "no.", nouns with a number, bare versions.

    A number of more than ``digits`` digits is none of a reference.
    """
    nouns = "|".join(REFERENCE_NOUNS)
    number, letter = rf"(\d{{1,{digits}}}(?:\.\d{{1,3}})?)", r"([A-Za-z])?\b"
    # each with what all of its references hold, which is found sooner
    forms = [
        (r"[A-Z][-/ ]?\d", rf"\b([A-Z]{{2,6}})[-/ ]?{number}{letter}", True),
        (r"[Nn]o\.?\s*\d", rf"\b([A-Z]{{2,6}})\s+[Nn]o\.?\s*(\d{{1,{digits}}})\b", False),
        (r"\d", rf"(?i)\b({nouns})\b\s*(?:no\.?|number|#|:)?\s*[-/]?\s*{number}{letter}", True),
    ]

    none = F.array().cast("array<string>")

    def of_form(said: Column, mark: str, pattern: str, has_letter: bool) -> Column:
        kept = F.filter(_groups(said, pattern, 1, 2, *([3] if has_letter else [])), lambda x: ~F.upper(x["g1"]).isin(*NOT_REFERENCES))
        return F.when(said.rlike(f"(?U){mark}"), F.transform(kept, lambda x: _reference(x["g1"], x["g2"], x["g3"] if has_letter else F.lit("")))).otherwise(none)

    version = r"(?i)\bv(\d{1,3})\b"

    def found(said: Column) -> Column:
        bare = F.when(said.rlike(r"(?U)[Vv]\d"), F.transform(_groups(said, version, 1), lambda x: _reference(F.lit("V"), x["g1"], F.lit("")))).otherwise(none)
        every = F.array_distinct(F.flatten(F.array(*(of_form(said, *f) for f in forms), bare)))
        return F.when(said.rlike(r"(?U)\d"), every).otherwise(none)

    return once(F.coalesce(text, F.lit("")), found)


def _iso(year: Column, month: Column, day: Column) -> Column:
    """ISO string if month and day are in 1-12 and 1-31 (a 31 February stays), else null."""
    y, m, d = (x.try_cast("int") for x in (year, month, day))
    digits = lambda x, n: F.coalesce(F.lpad(x.cast("string"), n, "0"), F.lit("null"))
    return F.when(m.between(1, 12) & d.between(1, 31), F.concat_ws("-", digits(y, 4), digits(m, 2), digits(d, 2)))


def _month(name: Column) -> Column:
    table = {m: i for names in (MONTHS, MONTH_NAMES) for i, m in enumerate(names, 1)} | {"sept": 9}
    return lookup(F.lower(name), table, F.lit(None).cast("int"))


def extract_dates(text: Column) -> Column:
    """Sorted distinct ISO dates; quoted-reply and header lines are skipped, D/M/Y is day first unless only M/D fits."""
    noise = r"(?Ui)^\s*(on\b.*\bwrote:|from:|sent:|to:|cc:|date:|subject:|-{2,}\s*original message)"
    num = lambda c: c.cast("int")
    mark = lambda pattern, sign="": lambda x: F.contains(x, F.lit(sign)) & x.rlike(f"(?U){pattern}")
    # each with what all of its dates hold: that is looked for in less time than the dates, as it begins with a rare character
    forms = [
        (mark("年", "年"), r"(\d{4})\s*年\s*(\d{1,2})\s*月\s*(\d{1,2})\s*日", lambda a, b, c: _iso(a, num(b), c)),
        (mark(r"-\d{1,2}-\d", "-"), r"\b(\d{4})-(\d{1,2})-(\d{1,2})\b", lambda a, b, c: _iso(a, num(b), c)),
        (mark(r"\d\s*[-/ ]?\s*[A-Za-z]{3,9}\.?,?\s*\d{4}"), r"\b(\d{1,2})\s*[-/ ]?\s*([A-Za-z]{3,9})\.?,?\s*(\d{4})\b", lambda a, b, c: _iso(c, _month(b), a)),
        (mark(r"\s\d{1,2},?\s+\d{4}"), r"\b([A-Za-z]{3,9})\.?\s+(\d{1,2}),?\s+(\d{4})\b", lambda a, b, c: _iso(c, _month(a), b)),
        (mark(r"/\d{1,2}/\d", "/"), r"\b(\d{4})/(\d{1,2})/(\d{1,2})\b", lambda a, b, c: _iso(a, num(b), c)),
        (mark(r"/\d{1,2}/\d", "/"), r"\b(\d{1,2})/(\d{1,2})/(\d{4})\b", lambda a, b, c: F.when((num(b) > 12) & (num(a) <= 12), _iso(c, num(a), b)).otherwise(_iso(c, num(b), a))),
        (mark(r"\.\d{1,2}\.\d{4}", "."), r"\b(\d{1,2})\.(\d{1,2})\.(\d{4})\b", lambda a, b, c: _iso(c, num(b), a)),
    ]
    none = F.array().cast("array<string>")

    def of_form(plain: Column, held, pattern: str, make) -> Column:
        return F.when(held(plain), F.transform(_groups(plain, pattern, 1, 2, 3), lambda x: make(x["g1"], x["g2"], x["g3"]))).otherwise(none)

    def of_line(line: Column) -> Column:
        found = lambda plain: F.when(plain != "", F.flatten(F.array(*(of_form(plain, *f) for f in forms)))).otherwise(none)
        return once(F.when(line.rlike(r"(?U)\d") & ~line.rlike(noise), ascii_forms(line)).otherwise(""), found)

    def of_text(t: Column) -> Column:
        lines = F.when(t.rlike(r"[\r\n]"), F.split(t, r"\r\n|\r|\n")).otherwise(F.array(t))
        return F.array_sort(F.array_distinct(F.filter(F.flatten(F.transform(lines, of_line)), lambda x: x.isNotNull())))

    return once(F.coalesce(text, F.lit("")), of_text)


def _value(digits: Column, multiplier: Column) -> Column:
    """Canonical decimal string: no separators, at most two decimals, no trailing zeros."""
    n = F.try_multiply(F.regexp_replace(digits, ",", "").cast("decimal(24,6)"), multiplier.cast("decimal(10,0)"))
    whole = n == F.floor(n)
    return F.when(whole, F.floor(n).cast("string")).otherwise(F.regexp_replace(F.bround(n, 2).cast("decimal(24,2)").cast("string"), r"\.?0+$", ""))


def extract_amounts(text: Column) -> Column:
    """Distinct ``{currency, value}`` of numbers with a currency mark before, or a Chinese one before or after."""
    plain = ascii_forms(text)
    marks = r"(HK\$|NT\$|US\$|S\$|HKD|NTD|RM|SGD|USD|EUR|GBP|MYR|RMB|CNY|[$€£¥])"
    words = "million|billion|thousand|mn|bn|m|k"
    digits = r"(\d{1,3}(?:,\d{3})++(?:\.\d++)?+|\d++(?:\.\d++)?+)"
    latin = rf"(?i){marks}\s?{digits}(?:\s?({words})\b)?+(?![千万亿])"
    before = rf"(?i:(人民币|港币|新台币|新币|RMB|¥))\s*(\d[\d,]*+(?:\.\d++)?+)\s*+(?:([千万亿])|(?!(?i:{words})\b))"
    after = r"(\d[\d,]*(?:\.\d+)?)\s*([千万亿])?\s*(?:元|圆)"
    one = F.lit(1).cast("bigint")
    times = lambda key: lookup(F.lower(key), {k: v for k, v in MULTIPLIERS.items()}, one)
    amount = lambda currency, value: F.struct(currency.alias("currency"), value.alias("value"))
    found = F.concat(
        F.transform(_find(plain, latin), lambda m: amount(lookup(F.lower(_group(m, latin, 1)), CURRENCIES, F.upper(_group(m, latin, 1))), _value(_group(m, latin, 2), times(_group(m, latin, 3))))),
        F.transform(_find(plain, before), lambda m: amount(lookup(F.lower(_group(m, before, 1)), CURRENCIES, F.lit("CNY")), _value(_group(m, before, 2), times(_group(m, before, 3))))),
        F.transform(_find(plain, after), lambda m: amount(F.lit("CNY"), _value(_group(m, after, 1), times(_group(m, after, 2))))),
    )
    return F.array_distinct(found)


def extract_percents(text: Column) -> Column:
    """Distinct ``N%`` of percent signs and words, in order."""
    pattern = r"(?i)(\d{1,3}(?:\.\d+)?)\s?%|(\d{1,3}(?:\.\d+)?)\s?(?:percent|per cent|pct)\b|百分之\s?(\d{1,3}(?:\.\d+)?)"
    return F.array_distinct(F.transform(_find(ascii_forms(text), pattern), lambda m: F.concat(F.regexp_extract(m, r"(?U)\d{1,3}(?:\.\d+)?", 0), F.lit("%"))))


def extract_emails(text: Column) -> Column:
    """Sorted distinct addresses, lower-cased, without trailing dots."""
    return F.array_sort(F.array_distinct(F.transform(_find(text, r"[\w.+-]+@[\w-]+\.[\w.-]+"), lambda m: F.rtrim(F.lower(m), F.lit(".")))))


def extract_links(text: Column) -> Column:
    """``{provider, url}`` of share links by provider, trailing punctuation trimmed; a url keeps its first provider."""

    def of_provider(name: str, pattern: str) -> Column:
        return F.transform(_find(text, f"(?i){pattern}"), lambda m: F.struct(F.lit(name).alias("provider"), F.rtrim(m, F.lit(").,;>\"'")).alias("url")))

    every = F.concat(*(of_provider(*p) for p in LINK_PROVIDERS.items()))
    empty = F.array().cast("array<struct<provider:string,url:string>>")
    return F.aggregate(every, empty, lambda acc, x: F.when(F.exists(acc, lambda y: y["url"] == x["url"]), acc).otherwise(F.array_append(acc, x)))


def extract_atoms(text: Column, digits: int = REFERENCE_DIGITS) -> Column:
    """All classes in one struct."""
    return F.struct(extract_refs(text, digits).alias("refs"), extract_dates(text).alias("dates"), extract_amounts(text).alias("amounts"), extract_emails(text).alias("emails"), extract_percents(text).alias("percents"))


def shape(token: Column) -> Column:
    """Structural signature: runs of upper letters, lower letters and digits become A, a and 9."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(token, "[A-Z]+", "A"), "[a-z]+", "a"), r"\d+", "9")


def candidate_refs(text: Column) -> Column:
    """Tokens with letters and digits that are no date, year or address."""
    found = F.transform(_find(text, r"\b[A-Za-z0-9]+(?:[-/#._][A-Za-z0-9]+)+\b|\b[A-Z]{2,6}#?\s?\d{1,8}\b"), lambda m: F.trim(m))
    return F.filter(found, lambda t: t.rlike("[A-Za-z]") & t.rlike("[0-9]") & ~F.contains(t, F.lit("@")) & (F.size(extract_dates(t)) == 0))
