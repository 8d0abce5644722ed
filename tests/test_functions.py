"""Column functions on literal cases."""

import datetime

import pytest
from pyspark.sql import functions as F

from missiva.functions import atoms, deadlines, names, text


@pytest.fixture(scope="module")
def one(spark):
    def run(make, *values):
        df = spark.createDataFrame([(v,) for v in values], "t string").select(make(F.col("t")).alias("x"))
        out = [r.x for r in df.collect()]
        return out[0] if len(out) == 1 else out

    return run


def test_references(one):
    got = one(atoms.extract_refs, "RFI-12 and NCR 07 then SOI-018 / CR-59 (VO09). EOT-5 TQ no. 3")
    assert got == ["RFI-12", "NCR-7", "SOI-18", "CR-59", "VO-9", "EOT-5", "TQ-3"]
    assert one(atoms.extract_refs, "rfi 12, PO #4471, invoice no. 88, clause 14.2, VO-09A, v2") == ["VO-9A", "RFI-12", "PO-4471", "INVOICE-88", "CLAUSE-14.2", "V-2"]
    assert one(atoms.extract_refs, "SGD 1,000 ISO 9001") == [] and one(atoms.extract_refs, None) == []


def test_dates(one):
    said = "14 Mar 2025; March 5, 2025; 3/14/2025; 03/04/2025; 2025/3/14; 15.06.2026; 2025年3月9日; 2025-02-31; 2025-13-01"
    assert one(atoms.extract_dates, said) == ["2025-02-31", "2025-03-05", "2025-03-09", "2025-03-14", "2025-04-03", "2026-06-15"]
    assert one(atoms.extract_dates, "On 1 Jan 2024 he wrote:\nSent: 2024-01-02\ndue 2024-01-03") == ["2024-01-03"]
    assert one(atoms.extract_dates, "２０２５年３月１４日") == ["2025-03-14"]


def test_amounts(one):
    got = lambda t: [(x.currency, x.value) for x in one(atoms.extract_amounts, t)]
    assert got("SGD 1,234.50, $2m, USD 500, RM 1k, HK$50") == [("SGD", "1234.5"), ("USD", "2000000"), ("USD", "500"), ("MYR", "1000"), ("HKD", "50")]
    assert got("RMB 1.2m") == [("CNY", "1200000")]
    assert got("人民币80万") == [("CNY", "800000")] and got("80万元") == [("CNY", "800000")]
    assert got("just 42") == []


def test_percents_emails_links(one):
    assert one(atoms.extract_percents, "5% then 7.5 percent, 百分之10, 5 %") == ["5%", "7.5%", "10%"]
    assert one(atoms.extract_emails, "B@x.com, a@Y.org. b@x.com") == ["a@y.org", "b@x.com"]
    links = [(x.provider, x.url) for x in one(atoms.extract_links, "see (https://www.dropbox.com/s/ab) and https://we.tl/t-x, https://www.dropbox.com/s/ab")]
    assert links == [("Dropbox", "https://www.dropbox.com/s/ab"), ("WeTransfer", "https://we.tl/t-x")]


def test_deadlines(one):
    got = [(x.kind, x.n, x.unit, x.direction, x.anchor) for x in one(deadlines.find_deadlines, "Net-30. Within 14 days of service, 2 weeks before the hearing; 5个工作日内")]
    assert got == [("net", 30, "days", "after", "invoice/receipt"), ("relative", 14, "days", "after", "service"), ("relative", 2, "weeks", "before", "the hearing"), ("within", 5, "businessdays", "after", "现在/收到")]


@pytest.mark.parametrize(
    ("n", "unit", "direction", "anchor", "due"),
    [
        (1, "months", "after", "2026-01-31", "2026-02-28"), (14, "businessdays", "after", "2025-03-03", "2025-03-21"), (2, "weeks", "before", "2025-03-15", "2025-03-01"),
        (3, "businessdays", "before", "2025-03-10", "2025-03-05"), (0, "businessdays", "after", "2025-03-08", "2025-03-08"), (1, "years", "after", "2025-03-08", None), (5, "days", "after", None, None),
    ],
)
def test_resolve(spark, n, unit, direction, anchor, due):
    got = spark.range(1).select(deadlines.resolve(F.lit(n), F.lit(unit), F.lit(direction), F.lit(anchor).cast("date")).alias("d")).first().d
    assert got == (datetime.date.fromisoformat(due) if due else None)


def test_holidays(spark):
    got = spark.range(1).select(deadlines.add_business_days(F.lit("2025-12-24").cast("date"), F.lit(2), ["2025-12-25", "2025-12-26"]).alias("d")).first().d
    assert got == datetime.date(2025, 12, 30)


def test_colloquial_and_recurrence(spark, one):
    at = lambda t: str(spark.range(1).select(deadlines.resolve_colloquial(F.lit(t), F.lit("2025-03-12").cast("date")).alias("d")).first().d)
    assert [at(t) for t in ("EOD", "tomorrow", "by Friday", "next Friday", "the 20th", "by the 5th", "someday")] == ["2025-03-12", "2025-03-13", "2025-03-14", "2025-03-21", "2025-03-20", "2025-04-05", "None"]
    assert one(deadlines.recurrence, "every week", "每季 report", "once", None) == ["weekly", "quarterly", "", ""]


def test_text(one):
    assert one(text.mask_identifiers, "MRN: 12345, S1234567A, a.b@c.de") == "[MRN], [NRIC], [EMAIL]"
    assert one(text.sensitivity, "outpatient morphine", "The patient", "Without Prejudice 保密", None) == [[], ["personal-data"], ["confidential", "without-prejudice"], []]
    assert one(text.html_to_text, "<p>a<br>b</p><script>x</script>&lt;c&gt; &amp;lt;") == "a\nb\n<c> &lt;"
    got = one(text.obligation_candidates, "Thanks for that. You must file it. Failing which it lapses! Is it done? Fine day")
    assert [(x.text, x.cues) for x in got] == [("You must file it", ["obligation"]), ("Failing which it lapses", ["waiver"]), ("Is it done", ["question", "request"])]


def test_names(one):
    assert one(names.company_key, "A&B Foundation (SG) Pte. Ltd", "Mega Company Limited", "Pte Ltd", None) == ["a&bfoundation", "mega", "", ""]
    assert one(names.company_code, "Mega Build Pte Ltd", "Tower", "") == ["MB", "TOWE", ""]
    assert one(names.is_automated, "no-reply@x.com", "jo@gmail.com", "a@mail.x.com", "b@u.mailchimp.com", "ann@firm.com") == [True, False, True, True, False]


def test_entities_dates_and_signatures(spark):
    from missiva.functions import mail
    from missiva.functions import text as words

    said = "a&#8217;s &eacute;t&eacute; &#x1F600; &amp;lt; &nope; &nbsp;b &copy;2024; x &#55296;"
    dates = ["Mon, 2 Jan 2023 10:00 +0800", "2 Jan 2023 10:00:05 EST", "02 jan 2023 9:00 (x)", "someday"]
    got = spark.createDataFrame([(said, d) for d in dates], "t string, d string").select(words.decode_entities(F.col("t")).alias("t"), mail.to_utc(F.col("d")).alias("d")).collect()
    assert got[0].t == "a\u2019s \u00e9t\u00e9 \U0001f600 &lt; &nope;  b \u00a92024; x &#55296;"
    assert [r.d for r in got] == ["2023-01-02T02:00:00Z", "2023-01-02T15:00:05Z", "2023-01-02T09:00:00Z", None]
    body = "Thanks for the file, see below.\nMore text\nKind regards,\n 12 Ann Tan 12 \nAcme"
    assert spark.createDataFrame([(body,)], "b string").select(mail.signature_zone(F.col("b")).alias("z")).first().z == ["12 Ann Tan 12", "Acme"]
