"""People and firms: folding, codes, signatures and trust against sequential rules."""

import random

import pytest
from pyspark.sql import functions as F

from missiva.operators import directory, people


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def fold(rows):
    """Take people one by one, busiest first; each takes the later ones that are like it."""
    bare = lambda n: "".join(c for c in (n or "").lower() if c == " " or "a" <= c <= "z").strip()
    rows = [dict(r) for r in sorted(rows, key=lambda r: (-r["count"], r["ordinal"]))]
    gone = set()
    for i, a in enumerate(rows):
        local, host = a["email"].split("@")
        if i in gone or not bare(a["name"]) or bare(a["name"]) == local:
            continue
        for j in range(i + 1, len(rows)):
            b = rows[j]
            other, site = b["email"].split("@")
            if j in gone or bare(b["name"]) != bare(a["name"]) or not ((host == site and 1 <= distance(local, other) <= 2) or (local == other and 1 <= distance(host, site) <= 2)):
                continue
            a["count"] += b["count"]
            a["aliases"] = list(dict.fromkeys(a["aliases"] + [b["email"]] + b["aliases"]))
            for f in ("position", "phone"):
                a[f] = a[f] or b[f]
            gone.add(j)
    return sorted((r["email"], r["name"], r["count"], r["position"], r["phone"], tuple(r["aliases"])) for i, r in enumerate(rows) if i not in gone)


@pytest.mark.parametrize("seed", range(3))
def test_folding_equals_the_sequential_rule(spark, seed):
    rnd = random.Random(seed)
    rows, used = [], set()
    for i in range(220):
        email = "".join(rnd.choice("ab") for _ in range(rnd.randint(1, 5))) + "@" + rnd.choice(["x.sg", "x.sh", "xy.sg", "long.example"])
        if email not in used:
            used.add(email)
            rows.append({"email": email, "name": rnd.choice(["Ann Lee", "ann  lee", "Bob", "bab", "", "Ann-Lee"]), "count": rnd.randint(1, 6), "position": rnd.choice(["", "", "QS", "PM"]), "phone": rnd.choice(["", "1", "2"]), "aliases": rnd.choice([[], ["old@y"]]), "ordinal": i})
    df = spark.createDataFrame(rows, "email string, name string, count long, position string, phone string, aliases array<string>, ordinal long")
    got = people.fold_people(df, filled=("position", "phone")).collect()
    assert sorted((r.email, r.name, r["count"], r.position, r.phone, tuple(r.aliases)) for r in got) == fold(rows)
    assert len(got) < len(rows)


def test_folding_awkward_rows(spark):
    schema = "email string, name string, count long, position string, company string, company_key string, phone string, aliases array<string>, ordinal long, `a` string"
    rows = [("ann@x.sg", "Ann", 1, None, "", "", "", None, 1, "p"), ("ann1@x.sg", "Ann", 5, "", "", "", None, None, 2, "q"), ("nobody", "Ann", 1, "", "", "", "", None, 3, "r"), (None, "Ann", 1, "", "", "", "", None, 4, "s")]
    got = people.fold_people(spark.createDataFrame(rows, schema))
    assert got.columns == ["email", "name", "count", "position", "company", "company_key", "phone", "aliases", "ordinal", "a"]
    assert sorted((r.email or "", r["count"], r.aliases, r.a) for r in got.collect()) == [("", 1, [], "s"), ("ann1@x.sg", 6, ["ann@x.sg"], "q"), ("nobody", 1, [], "r")]
    assert people.fold_people(got.limit(0)).count() == 0


def codes(rows):
    used, out = {}, []
    for at, base, given in sorted(rows):
        code, n = given or base, 2
        while not given and code in used:
            code, n = f"{base}{n}", n + 1
        used.setdefault(code, at)
        out.append((at, code))
    return out


def test_codes_are_unique(spark):
    frame = lambda rows: spark.createDataFrame(rows, "first_seen long, code string, fixed string")
    got = lambda rows: sorted((r.first_seen, r.unique_code) for r in directory.unique_codes(frame(rows), given="fixed").collect())
    assert got([(1, "AB", None), (2, "AB", None), (3, "AB2", None)]) == [(1, "AB"), (2, "AB2"), (3, "AB22")]
    rnd = random.Random(4)
    for _ in range(4):
        rows = [(i, rnd.choice(["A", "A", "A2", "A3", "A22", "A5", "B"]), rnd.choice([None] * 6 + ["", "A2", "A4", "B"])) for i in range(80)]
        assert got(rows) == codes(rows)
    assert got([]) == []


SIGNATURES = [
    # body, company, position, phone, name
    ("Hi team,\n\nSee attached.\n\nBest regards,\nAlice Tan\nSenior Project Manager\nNorthwind Engineering Pte Ltd\nMobile: +65 9123 4567\nFax: +65 6000 0000\n", "Northwind Engineering Pte Ltd", "Senior Project Manager", "+65 9123 4567", "Alice Tan"),
    ("Noted.\n\nRegards,\nBob Lee\n\n> Best regards,\n> Gary Tan\n> Hooli Holdings Pte Ltd\n> Mobile: +65 8000 1111\n", "", "", "", "Bob Lee"),
    ("Dear Hooli Holdings Pte Ltd,\n\nWe refer to your mail.\n\nRegards,\nLim Wei\nNorthwind Builders Pte Ltd\n", "Northwind Builders Pte Ltd", "", "", "Lim Wei"),
    ("Regards,\nChan Boon\nAcme Lifts Pte Ltd\n\nThis email is confidential. Please notify Acme Lifts (Singapore) Pte Ltd.\n", "Acme Lifts Pte Ltd", "", "", "Chan Boon"),
    ("Regards,\nJo\nRef 12345678901234567890\n", "", "", "", "Jo"),
    ("Regards,\nWin\nADF Waterproof Pte Ltd,\n25 Mandai Estate\n", "ADF Waterproof Pte Ltd", "", "", "Win"),
    ("Regards,\nEve Tan\nGlobex (S)\nPte Ltd\n", "Globex (S) Pte Ltd", "", "", "Eve Tan"),
    ("Regards,\nPte Ltd\n", "", "", "", ""),
    ("Rgds\nKim\nfor MEGA BUILD CO PTE LTD\nOffice fax 6123 4567\nTel 6222-3333 4444\nHP: 9111 2222 3333", "Mega Build Co Pte Ltd", "", "6222-3333 4444", "Kim"),
    ("B.R.\n* Support Team *\nAnn\nABC PTE. LTD.\n6123 4567 1111\n6999 4567 2222", "ABC Pte. Ltd", "", "6999 4567 2222", "Ann"),
    ("Thanks & regards\r\n\r\n-- Mei Lin\r\nHead of Sales Manager\r\n发送时间: 2024\r\nX Ltd", "", "Head of Sales Manager", "", "Mei Lin"),
    ("one\ntwo\n-----Original Message-----\nRegards\nX Ltd", "", "", "", "one"),
    ("", "", "", "", ""), (None, "", "", "", ""),
]


def test_signatures(spark):
    from missiva.functions.signature import with_signatures

    rows = spark.createDataFrame([(i, s[0]) for i, s in enumerate(SIGNATURES)], "i int, body string")
    got = {r.i: (r.company, r.position, r.phone, r.signed) for r in with_signatures(rows).collect()}
    assert got == {i: s[1:] for i, s in enumerate(SIGNATURES)}


def test_company_names_as_shown(spark):
    from missiva.functions.signature import company_display

    names = {"MEGA BUILD CO PTE LTD": "Mega Build Co Pte Ltd", "for  A&B Foundation Specialist pte ltd.": "A&B Foundation Specialist Pte Ltd", "GCC LIMITED": "GCC Limited", "O'NEIL & SONS LLP": "O'Neil & Sons LLP", "dear re Acme Corp,": "Acme Corp", "": "", None: ""}
    rows = spark.createDataFrame([(k,) for k in names], "n string").select("n", company_display(F.col("n")).alias("d")).collect()
    assert {r.n: r.d for r in rows} == names


def test_a_lone_foreign_signature_names_no_domain(spark):
    def book(*rows):
        who = spark.createDataFrame([(e, n, 1, i) for i, (e, n, *_) in enumerate(rows)], "email string, name string, count int, ordinal int")
        said = [(e, z, c, "QS", "9", s) for e, _, c, s, z in rows if c is not None]
        signed = spark.createDataFrame(said, "email string, zone array<string>, company string, position string, phone string, signed string")
        return {r.email: (r.company, r.company_key, r.position, r.name) for r in people.signed_directory(who, signed).collect()}

    got = book(
        ("projects@vendor.com", "", "Brand Works LLC", "", ["Brand Works LLC"]), ("ann@vendor.com", "Ann Lee", None, None, None),  # alone, and not like the domain
        ("alex@globex.com", "Alex Tan", "Hooli Pte Ltd", "Alex Tan", []), ("ben@globex.com", "Ben", "Umbrella Ltd", "Carol Wong", []),  # own, and somebody else's
        ("info@contoso.com", "", "", "", ["Contoso", "x"]), ("jo@contoso.com", "", None, None, None),  # a line about the domain
        ("sales@acme.com", "", "Acme Ltd", "", []), ("sales@other.com", "", "Acme Ltd", "", []), ("info@acme.com", "", "Acme Ltd", "", []),  # signed mostly at acme.com
        ("me@gmail.com", "Me Too", "Acme Ltd", "Me Too", []), ("none", "X", None, None, None),
    )
    assert got["projects@vendor.com"][:2] == got["ann@vendor.com"][:2] == ("", "vendor.com")
    assert got["alex@globex.com"] == ("Hooli Pte Ltd", "hooli", "QS", "Alex Tan") and got["ben@globex.com"] == ("Hooli Pte Ltd", "hooli", "", "Ben")
    assert got["jo@contoso.com"] == ("Contoso", "contoso", "", "Jo") and got["info@acme.com"][:2] == ("Acme Ltd", "acme") and got["sales@other.com"] == ("", "other.com", "", "")
    assert got["me@gmail.com"] == ("", "", "QS", "Me Too") and got["none"] == ("", "", "", "X")
