"""Evaluation, link outcomes, firms, projects and look-ups on small tables with awkward rows."""

import random

import pytest
from pyspark.sql import functions as F

from missiva.functions.names import firm_code
from missiva.operators import book, links, scoring

LINKS = "message_id string, url string, provider string, status string, file string, size long, confirmed boolean, ordinal long"


@pytest.mark.parametrize(
    ("name", "code"),
    [("Mega Build Co Pte Ltd", "MB"), ("Acme", "ACME"), ("Bank of the East", "BE"), ("Foo (Asia) Bar Inc.", "FB"), ("Pte Ltd", "PTEL"), ("", "NA"), (None, "NA"), ("a b c d e f g h", "BCDEFG"), ("Company House", "CH"), ("(Only)", "ONLY")],
)
def test_firm_code(spark, name, code):
    assert spark.createDataFrame([(name,)], "name string").select(firm_code(F.col("name"))).first()[0] == code


def by_hand(rows):
    """Pending records settled one by one from what is known of their url before."""
    done, large, dead, auth = {}, {}, set(), set()
    for _, url, _, status, file, size, _, _ in sorted(rows, key=lambda r: r[7]):
        if status == "downloaded" and file:
            done[url] = file
        elif status == "needs-confirm":
            large[url] = size
        elif status in ("dead", "needs-auth"):
            (dead if status == "dead" else auth).add(url)
    told, work = {}, {}
    for message, url, provider, status, _, _, sure, _ in rows:
        if status != "pending":
            continue
        if url in done:
            told[message] = ("downloaded", done[url], None)
        elif not sure and url in large:
            told[message] = ("needs-confirm", None, large[url])
        elif not sure and url in dead:
            told[message] = ("dead", None, None)
        elif not sure and url in auth:
            told[message] = ("needs-auth", None, None)
        else:
            work[url] = work.get(url, False) or bool(sure)
    return told, work


@pytest.mark.parametrize("seed", range(3))
def test_fetch_plan_equals_one_record_at_a_time(spark, seed):
    rng = random.Random(seed)
    states = ["pending"] * 4 + ["downloaded", "dead", "needs-auth", "needs-confirm", "error", "infected"]
    rows = [(f"m{i}", f"u{rng.randrange(40)}", "Box", s := rng.choice(states), rng.choice([f"f{i}", "", None]) if s == "downloaded" else None, i if s == "needs-confirm" else None, rng.choice([True, False, None]), i) for i in range(200)]
    every = spark.createDataFrame(rows, LINKS)
    settled, work = links.fetch_plan(every)
    told, todo = by_hand(rows)
    assert {r.message_id: (r.status, r.file, r.size) for r in settled.collect()} == told
    assert {r.url: r.confirmed for r in work.collect()} == todo
    after = {r.message_id: r for r in links.applied(every, settled).collect()}
    assert len(after) == len(rows)
    assert all(after[m].status == told.get(m, (s,))[0] for m, _, _, s, *_ in rows)


def test_links_of_nothing(spark):
    none = spark.createDataFrame([], LINKS + ", path string")
    settled, work = links.fetch_plan(none)
    assert settled.collect() == work.collect() == links.triage(none).collect() == links.status_counts(none).collect() == []
    assert links.thread_links(none, spark.createDataFrame([], "thread_id string, message_id string, path string")).collect() == []


def test_thread_links_by_id_then_path(spark):
    members = spark.createDataFrame([("t1", "a", "in\\1.eml"), ("t2", "b", "in/2.eml"), ("t3", None, "")], "thread_id string, message_id string, path string")
    rows = [("a", "in/2.eml", "downloaded"), ("x", "in/1.eml", "needs-auth"), (None, "in\\2.eml", None), (None, None, "pending"), ("", "", "pending")]
    got = links.thread_links(spark.createDataFrame(rows, "message_id string, path string, status string"), members)
    assert sorted(map(tuple, got.collect())) == [("t1", 2, 1, 1), ("t2", 1, 0, 1)]


def test_evaluation(spark):
    text = "Ref PO-1 of 14 Mar 2025, SGD 1,000 due. See PO-2."
    facts = {"refs": ["see PO-1"], "dates": ["2025-03-14"], "amounts": ["SGD 1000"], "parties": ["Bob <BOB@x.example>"], "actions": [" Pay Up "], "odd": None}
    outputs = spark.createDataFrame([("t", "2", facts), ("t", "1", {}), ("n", "1", None), ("lost", "1", {}), (None, "1", {})], "thread_id string, ts string, facts map<string,array<string>>")
    sources = spark.createDataFrame([("t", text), ("n", None)], "thread_id string, text string")
    gold = spark.createDataFrame(
        [("t", True, {"refs": ["PO-1", "PO-1"], "actions": ["pay up", "call"], "emails": ["bob@x.example"], "none": None}), ("n", True, {}), ("x", True, {"refs": ["PO-9"]}), ("lost", False, {"refs": ["PO-9"]})],
        "thread_id string, confirmed boolean, atoms map<string,array<string>>",
    )
    told = scoring.evaluate(outputs, sources, gold)
    rows = {(r.thread_id, r.side, r.kind): (r.required, tuple(r.missed)) for r in told.collect()}
    assert rows[("t", "floor", "refs")] == (2, ("PO-2",)) and rows[("t", "floor", "dates")] == (1, ()) and rows[("t", "floor", "amounts")] == (1, ())
    assert rows[("t", "gold", "refs")] == (1, ()) and rows[("t", "gold", "actions")] == (2, ("call",)) and rows[("t", "gold", "emails")] == (1, ()) and rows[("t", "gold", "none")] == (0, ())
    assert rows[("n", "gold", None)] == (0, ()) and len(rows) == 11
    assert scoring.evaluation_summary(told).first().asDict() == {"comprehended": 2, "hard_misses": 1, "gold_threads": 2, "zero_miss": 1, "no_miss_rate": 0.5}
    recalls = {(r.side, r.kind): r.recall for r in scoring.evaluation_recall(told).collect()}
    assert recalls[("gold", "actions")] == 0.5 and recalls[("gold", "none")] == 1.0 and recalls[("floor", "refs")] == 0.5
    none = scoring.evaluate(outputs.limit(0), sources, gold)
    assert scoring.evaluation_summary(none).first().asDict() == {"comprehended": 0, "hard_misses": 0, "gold_threads": 0, "zero_miss": 0, "no_miss_rate": None}


def test_firm_book(spark):
    people = spark.createDataFrame(
        [("a@ab.example", "Ann", "ab", "Alpha Build Pte Ltd", "ab.example"), ("b@ab.example", "", "ab", "Alpha Build", "ab.example"), ("c@ab.example", "bo", "ab", "Alpha Build", "ab.example"),
         ("d@old.example", "Dan", "old", "Alpha Bau", "old.example"), ("e@zz.example", None, "zz", "", "zz.example"), ("f@q.example", "Fay", "q", None, None), ("g@mail.example", "Gil", None, "", "")],
        "email string, name string, company_key string, company string, domain string",
    )
    merges = spark.createDataFrame([("old", "ab")], "from_key string, to_key string")
    wishes = spark.createDataFrame([("zz", "code", "AB"), ("q", "name", "Quay Bank"), ("zz", "description", " "), ("q", "pin", "on")], "key string, kind string, value string")
    took = spark.createDataFrame([("North", "d@old.example"), ("South", "a@ab.example"), ("South", "x@ab.example")], "project string, email string")
    got = {r.key: r for r in book.firm_book(people, wishes, merges, took).collect()}
    assert set(got) == {"ab", "zz", "q"}
    assert (got["ab"].name, got["ab"]["count"], got["ab"].projects) == ("Alpha Build", 4, ["North", "South"])
    assert (got["zz"].name, got["zz"].unverified, got["zz"].code) == ("zz.example", True, "AB")
    assert (got["q"].name, got["q"].unverified, got["q"].domain, got["q"].code) == ("Quay Bank", False, "q", "QB")
    ordered = [r.email for r in book.firm_people(people, merges).where("key = 'ab'").orderBy("place").collect()]
    assert ordered == ["a@ab.example", "b@ab.example", "c@ab.example", "d@old.example"]


def test_look_alikes(spark):
    names = ["Hooli Holding", "Hooli Holdings Ltd", "HOOLI Holding Pte", "A&B Works", "A&B Work", "Acme", "Acmes", "Zed", "Pte Ltd", None]
    firms = spark.createDataFrame([(n, False) for n in names] + [("Hooli Holdin", True)], "name string, unverified boolean")
    pairs, members = book.look_alikes(firms)
    assert {(r.a, r.b) for r in pairs.collect()} == {("hooliholding", "hooliholdings"), ("a&bwork", "a&bworks")}
    assert {(r.name, r.names) for r in members.collect()} == {("Hooli Holding", 2), ("HOOLI Holding Pte", 2), ("Hooli Holdings Ltd", 1), ("A&B Works", 1), ("A&B Work", 1)}


def test_projects_and_look_ups(spark):
    rows = [("t1", "North  Yard", "x"), ("t2", "north yard", "y"), ("t3", "north yard", "y"), ("t4", "N Yard", None), ("t5", "N Yard", ""), ("t6", "N Yard", "x"), ("t7", " ", "x"), ("t8", None, "x")]
    records = spark.createDataFrame(rows, "thread_id string, project string, category string")
    merges = spark.createDataFrame([("n yard", "north yard"), ("loop", "pool"), ("pool", "loop")], "from_key string, to_key string")
    found = book.project_book(records, merges)
    assert [tuple(r) for r in found.collect()] == [("north yard", "north yard", 6, ["x", "y"])]
    asked = spark.createDataFrame([("n yard",), ("north yard",), ("n yard",), ("loop",), (None,)], "key string")
    assert sorted(r.asked for r in book.look_up(found, asked, "key", merges).collect()) == ["n yard", "north yard"]
    assert book.look_up(found, asked, "key").count() == 1
    keys = spark.createDataFrame([("t", "Pay  UP!"), ("t", "pay-up"), ("u", "pay up"), ("t", None)], "t string, x string").select(book.item_key(F.col("t"), F.col("x"))).collect()
    assert keys[0] == keys[1] != keys[2] and len(keys[3][0]) == 12
    assert sorted(map(tuple, book.chips(records, ["category"]).collect())) == [("category", "x", 4), ("category", "y", 2)]


def test_orders(spark):
    firms = spark.createDataFrame([("k1", "zeta", False, 1), ("k2", "Alpha", False, 3), ("k3", "aaa", True, 3), ("k4", "beta", False, 3)], "key string, name string, unverified boolean, count long")
    assert [r.key for r in firms.orderBy(*book.firm_order()).collect()] == ["k2", "k4", "k1", "k3"]
    assert [r.key for r in firms.orderBy(*book.busiest_order()).collect()] == ["k3", "k2", "k4", "k1"]
