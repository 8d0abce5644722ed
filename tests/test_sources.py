"""Files in and out."""

from email.message import EmailMessage

import pytest
from pyspark.sql import functions as F

from missiva.functions import mail as fields
from missiva.functions.signature import signature_phone
from missiva.schemas import RULES
from missiva.sources import mail, tables


def test_json_lines(spark, tmp_path):
    path = tmp_path / "rules.jsonl"
    path.write_text('{"type": "keyword", "match": "a", "ts": 1}\n\nnot json\n[1]\n{"type": "sender", "extra": 1}\n{"type": \n')
    got = tables.scan_json_lines(spark, str(path), RULES).orderBy("type").collect()
    assert [(r.type, r.match, r.ts) for r in got] == [("keyword", "a", 1.0), ("sender", None, None)]
    assert tables.rejected_lines(spark, str(path)).count() == 3
    odd = tmp_path / "odd.jsonl"
    odd.write_text('{"id": "a", "size": 1, "tags": ["x"]}\n{"id": "b", "size": "12"}\n{"id": "c", "size": {"n": 1}, "tags": "x"}\n[{"id": "arr"}]\n"text"\n')
    rows = tables.scan_json_lines(spark, str(odd), "id string, size long, tags array<string>", places=True).orderBy("ordinal").collect()
    assert [(r.id, r.size, r.tags) for r in rows] == [("a", 1, ["x"]), ("b", 12, None), ("c", None, None)] and rows[0].file_name.endswith("odd.jsonl")
    with pytest.raises(Exception):
        tables.scan_json_lines(spark, str(path), RULES, strict=True).collect()


def test_versions_and_logs(spark, tmp_path):
    root = str(tmp_path / "t")
    tables.write_version(spark.range(3), root)
    tables.write_version(spark.range(5), root)
    assert tables.read_version(spark, root).count() == 5
    tables.append(spark.range(2), root + "-log")
    tables.append(spark.range(2), root + "-log")
    assert spark.read.parquet(root + "-log").count() == 4
    tables.export_csv(spark.range(2).withColumn("name", F.lit("a,b")), root + "-csv", ["name", "id"])
    assert spark.read.option("header", True).csv(root + "-csv").columns == ["name", "id"]


def test_mail_files(spark, tmp_path):
    a = EmailMessage()
    a["From"], a["To"], a["Subject"], a["Message-ID"], a["Date"] = "Ann <Ann@X.com>", "b@y.org, ann@x.com", "Re: plan", "<A@x>", "Fri, 05 Jan 2024 10:00:00 +0800"
    a["In-Reply-To"], a["References"] = "<root@x>", "<root@x> <mid@x>"
    a.set_content("hello")
    a.add_attachment(b"data", maintype="application", subtype="pdf", filename="f.pdf")
    b = EmailMessage()
    b["From"], b["Date"] = "c@z.net", "no date"
    b.set_content("<p>hi <img src='cid:pic1'></p>", subtype="html")
    b.add_related(b"img", "image", "png", cid="<pic1>", filename="pic.png", disposition="inline")
    for name, m in (("a", a), ("b", b)):
        (tmp_path / f"{name}.eml").write_bytes(m.as_bytes())
    files = mail.message_files(spark, str(tmp_path))
    got = {r.path[-5:]: r for r in mail.headers(files).collect()}
    r = got["a.eml"]
    assert (r.mid, r.date, r.refs, r.addrs, r.attach) == ("a@x", "2024-01-05T02:00:00Z", ["root@x", "root@x", "mid@x"], ["ann@x.com", "b@y.org"], True)
    assert (got["b.eml"].mid, got["b.eml"].date) == ("", None)
    body = {r.path[-5:]: r for r in mail.bodies(files).collect()}
    assert body["a.eml"].body.strip() == "hello" and [(x.name, x.size) for x in body["a.eml"].attachments] == [("f.pdf", 4)]
    assert body["b.eml"].is_html and body["b.eml"].attachments == []
    ids = {r.path[-5:]: r.id for r in mail.index(files, mail.headers(files)).collect()}
    assert ids["a.eml"] == "a@x" and ids["b.eml"].startswith("uid_")


def test_attachment_text(spark, tmp_path):
    (tmp_path / "a.txt").write_text("héllo")
    (tmp_path / "b.pdf").write_bytes(b"%PDF")
    got = {r.path[-5:]: (r.text, r.ok, r.note) for r in mail.attachment_text(mail.message_files(spark, str(tmp_path), "*.*")).collect()}
    assert got == {"a.txt": ("héllo", True, ""), "b.pdf": (None, False, "not read: .pdf")}


def test_fields(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(fields.clean_subject(F.lit("RE: Fwd: aw:  Plan"))) == "Plan" and one(fields.clean_subject(F.lit("re: "))) == "(no subject)"
    assert one(fields.header_ids(F.lit("<A@x> junk <b@y>"))) == ["a@x", "b@y"]
    assert one(fields.to_utc(F.lit("Fri, 5 Jan 2024 10:00:00 +0800 (SGT)"))) == "2024-01-05T02:00:00Z"
    assert one(fields.to_utc(F.lit("5 Jan 2024 10:00:00"))) == "2024-01-05T10:00:00Z" and one(fields.to_utc(F.lit("soon"))) is None
    assert one(fields.folder_path(F.lit("In box/Sub\\x?y"))) == "In_box/Sub/x_y"
    said = "Hi Bob\nsee below\nBest regards,\nAnn Lee\nMega Build Pte Ltd\nFax 6123 4567\nTel +65 6123 9999\nOn Mon, Bob wrote:\n> old"
    assert one(fields.own_text(F.lit(said))).endswith("9999")
    zone = fields.signature_zone(F.lit(said))
    assert one(zone)[0] == "Ann Lee" and one(signature_phone(zone)) == "+65 6123 9999"
    assert one(fields.pack_messages(F.array(*(F.lit(n).cast("long") for n in (5, 5, 3, 20, 1))), 10)) == [1, 1, 2, 3, 4]
