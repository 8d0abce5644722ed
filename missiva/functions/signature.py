"""Company, title, phone and name in the lines of a signature."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from missiva.functions.mail import signature_zone
from missiva.functions.names import LEGAL, company_key
from missiva.functions.steps import once

# Legal forms that end a company's name, words that lead to it, and how legal words are written.
LEGAL_FORMS = (
    r"Pte\.?\s*Ltd", r"Sdn\.?\s*Bhd", r"Co\.?\s*,?\s*Ltd", r"Company\s+Limited", "Berhad", "Limited", "Ltd", "LLP", "LLC", r"L\.?L\.?C", "Inc", "GmbH", "Corp(?:oration)?", r"S\.?A\.?", r"N\.?V\.?", "Pte",
)
LEADS = ("for", "at", "with", "to", "from", "by", "of", "and", "dear", "attn", "re", "fw", "fwd", "via", "c/o", "c-o")
LEGAL_CASE = {
    "pte": "Pte", "ltd": "Ltd", "sdn": "Sdn", "bhd": "Bhd", "llp": "LLP", "llc": "LLC", "inc": "Inc", "gmbh": "GmbH", "co": "Co", "corp": "Corp", "corporation": "Corporation", "limited": "Limited",
    "berhad": "Berhad", "company": "Company", "plc": "PLC",
}
EDGES = " .,-|'’"

# Ranks, fields and offices of a title.
RANKS = ("Senior ", "Snr ", "Junior ", "Jr ", "Chief ", "Deputy ", "Assistant ", "Asst ", "Principal ", "Lead ", r"Head\s+of\s+")
FIELDS = (r"Project\s+", r"Site\s+", r"Sales\s+", r"Account\s+", r"General\s+", r"Operations\s+", r"Business\s+")
OFFICES = (
    "Manager", "Director", "Engineer", "Executive", "Officer", "President", "CEO", "CFO", "CTO", "COO", "Consultant", "Architect", "Surveyor", "Coordinator", "Supervisor", "Specialist", "Administrator",
    "Analyst", "Partner", "Associate", "Designer", "Technician", "Draftsman", "Drafter", "Foreman", "Estimator", "Planner", "Secretary", "Accountant",
)

# Numbers, their labels, and lines that name nobody.
PHONE = r"(?:(?:\+|00)\d[\d\s().-]{6,}\d|\(?\d{2,4}\)?[\s.-]\d{3,4}[\s.-]\d{3,4})"
PHONE_LABELS = ("mobile", "mob", "hp", "cell", "tel", "phone", "direct", "did", "contact", "m", "t", "p", "d")
GENERIC = ("team", "support", "dept", "department", "sales", "admin", "service", "desk", "group", "division", "office", "hotline", r"enquir\w*", "customer", "projects?", r"the\s+\w+")
OPENERS = ("your", "the", "dear", "hi", "hello")

COMPANY = rf"(?iU)([A-Z0-9][\w&.,'’()\-/ ]{{1,58}}?\b(?:{'|'.join(LEGAL_FORMS)}))\b\.?(?:\s*\([^)]{{0,40}}\))?[\s.,;:]*$"
#: What a line with a company's name ends with; quick to rule out, as the name before it is not.
COMPANY_END = rf"(?iU)\b(?:{'|'.join(LEGAL_FORMS)})\b\.?(?:\s*\([^)]{{0,40}}\))?[\s.,;:]*$"
TITLE = rf"(?iU)\b(?:{'|'.join(RANKS)})?(?:Managing\s+)?(?:{'|'.join(FIELDS)})?(?:{'|'.join(OFFICES)})s?\b"
NOBODY = rf"(?iU)\b(?:{'|'.join(GENERIC)})\b|^\s*(?:{'|'.join(OPENERS)})\b"


def company_display(raw: Column) -> Column:
    """A company's name as it is shown: no words that lead to it, no marks at its edges, shouted names in title case, legal words in their usual spelling."""
    n = F.trim(F.regexp_replace(F.coalesce(raw, F.lit("")), r"\s+", " "), F.lit(EDGES))
    n = F.trim(F.regexp_replace(n, rf"(?i)^(?:(?:{'|'.join(LEADS)})\b[\s,:./-]*)+", ""), F.lit(EDGES))
    letters = lambda t: F.regexp_replace(t, "[^A-Za-z]", "")
    usual = F.create_map(*(F.lit(x) for kv in LEGAL_CASE.items() for x in kv))
    title = lambda t: F.array_join(F.transform(F.regexp_extract_all(t, F.lit("([A-Za-z]+|[^A-Za-z]+)"), F.lit(1)), lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.lower(F.substring(x, 2, 200)))), "")

    def cased(own: Column) -> Column:
        acronym = (F.size(own) == 1) & F.forall(own, lambda a: (a == F.upper(a)) & (F.char_length(a) <= 6))
        shouted = (F.size(own) > 0) & F.forall(own, lambda a: a == F.upper(a))
        return acronym | ~shouted

    def shown(t: Column, as_is: Column) -> Column:
        bare = letters(t)
        return once(F.try_element_at(usual, F.lower(bare)), lambda known: F.when(known.isNotNull(), F.replace(t, bare, known)).when(as_is, t).otherwise(title(t)))

    def joined(words: Column) -> Column:
        own = F.filter(F.transform(words, letters), lambda a: (a != "") & ~F.lower(a).isin(*LEGAL))
        return once(once(own, cased), lambda as_is: F.array_join(F.transform(words, lambda t: shown(t, as_is)), " "))

    return once(F.filter(F.split(n, " "), lambda t: t != ""), joined)


def signature_company(zone: Column) -> Column:
    """The first name that ends in a legal form at the end of its line; a legal form alone takes the line before it."""

    def named(line: Column, before: Column, i: Column) -> Column:
        joined = F.concat(F.trim(before, F.lit(EDGES)), F.lit(" "), line)
        both = once(joined, lambda x: F.when(x.rlike(COMPANY), company_display(F.regexp_extract(x, COMPANY, 1))))
        one = once(company_display(F.regexp_extract(line, COMPANY, 1)), lambda n: F.when((company_key(n) == "") & (i > 0), F.coalesce(both, n)).otherwise(n))
        return F.when(line.rlike(COMPANY_END) & line.rlike(COMPANY), one).otherwise("")

    fit = F.filter(once(zone, lambda z: F.transform(z, lambda x, i: named(x, F.try_element_at(z, i), i))), lambda n: (company_key(n) != "") & (F.char_length(n) >= 3) & ~n.rlike("(?i)^(?:re|fw|fwd) "))
    return F.coalesce(F.try_element_at(fit, F.lit(1)), F.lit(""))


def signature_title(zone: Column) -> Column:
    """The first title in the lines."""
    return F.trim(F.regexp_extract(F.array_join(zone, "\n"), TITLE, 0))


def signature_phone(zone: Column) -> Column:
    """A number of 7 to 15 digits on a line that names no fax: the first labelled one, else the last."""
    found = F.transform(F.filter(zone, lambda x: ~x.rlike(r"(?i)\bfax\b")), lambda x: F.struct(F.regexp_extract(x, PHONE, 0).alias("number"), x.rlike(rf"(?iU)\b(?:{'|'.join(PHONE_LABELS)})\b").alias("labelled")))
    fit = F.filter(found, lambda x: F.length(F.regexp_replace(x["number"], r"\D", "")).between(7, 15))
    number = F.coalesce(F.try_element_at(F.filter(fit, lambda x: x["labelled"]), F.lit(1)), F.try_element_at(fit, F.lit(-1)))["number"]
    return F.coalesce(F.trim(number, F.lit(" .-")), F.lit(""))


def signature_name(zone: Column) -> Column:
    """The first of the top four lines that has one to four words and is no company, title, number or department."""
    odd = lambda x: (x.rlike(COMPANY_END) & x.rlike(COMPANY)) | x.rlike(TITLE) | x.rlike(PHONE) | x.rlike(NOBODY)
    words = lambda x: F.size(F.filter(F.split(F.regexp_replace(x, "[^A-Za-z ]", " "), " "), lambda w: F.char_length(w) >= 2))
    return F.coalesce(F.trim(F.try_element_at(F.filter(F.slice(zone, F.lit(1), F.lit(4)), lambda x: ~odd(x) & words(x).between(1, 4)), F.lit(1))), F.lit(""))


def with_signatures(messages: DataFrame, body: str = "body") -> DataFrame:
    """``messages`` with ``zone`` (the lines of the signature), ``company``, ``position``, ``phone`` and ``signed`` (a name); empty where there is none, or no body."""
    read = {"company": signature_company, "position": signature_title, "phone": signature_phone, "signed": signature_name}
    found = once(signature_zone(F.col(body)), lambda zone: F.struct(zone.alias("zone"), *(f(zone).alias(c) for c, f in read.items())))
    staged = messages.withColumn("__signature", found)
    return staged.withColumns({c: F.col(f"__signature.{c}") for c in ("zone", *read)}).drop("__signature")
