"""What must hold for tables of any size: nothing large is broadcast, keys may be long, work per row does not repeat."""

import duckdb
import numpy as np
import pytest
from duck import rows as plain_rows
from pyspark.sql import functions as F

from missiva.operators import directory, matters


def broadcast(df):
    """The lines of a plan that stand below a broadcast."""
    out, depth = [], None
    for line in df._jdf.queryExecution().sparkPlan().toString().splitlines() + df._jdf.queryExecution().executedPlan().toString().splitlines():
        at = len(line) - len(line.lstrip(" :+-*|"))
        if depth is not None and at <= depth:
            depth = None
        if depth is not None:
            out.append(line)
        elif "BroadcastExchange" in line:
            depth = at
    return "\n".join(out)


@pytest.mark.parametrize("most", [10_000, 0])
def test_rules_never_broadcast_the_items(spark, tmp_path, monkeypatch, most):
    monkeypatch.setattr(matters, "FEW_RULES", most)
    rows = [(i, f"word{i} please confirm", f"user{i}@firm{i % 9}.", f"tower {i % 5}") for i in range(50)]
    spark.createDataFrame(rows, "id long, text string, sender string, project string").write.parquet(f"{tmp_path}/items")
    spark.createDataFrame([("keyword", "confirm", "a", 1), ("sender", "@firm7.", "b", 2), ("project", "tower 2", "c", 3)], "kind string, match string, category string, ordinal int").write.parquet(f"{tmp_path}/rules")
    got = matters.match_rules(spark.read.parquet(f"{tmp_path}/items"), spark.read.parquet(f"{tmp_path}/rules"), "id")
    assert "/items" not in broadcast(got)
    assert {r.id: r.category for r in got.collect()} == {i: "c" if i % 5 == 2 else "b" if i % 9 == 7 else "a" for i in range(50)}


def test_people_of_one_name_meet_directly_or_by_remainders(spark, monkeypatch):
    rows = [(f"ann{i}@firm.example", "Ann") for i in range(30)] + [("bob@a.example", "Bob"), ("bob@ab.example", "Bob"), ("bob@a.example", "Bob")]
    people = spark.createDataFrame(rows, "email string, name string")
    pairs = lambda: sorted((r.a, r.b) for r in directory.duplicate_people(people).collect())
    direct = pairs()
    assert len(direct) == len(set(direct)) == 30 * 29 // 2 + 1
    monkeypatch.setattr(directory, "FEW_NAMESAKES", 1)
    assert pairs() == direct


def test_people_are_never_broadcast_with_their_remainders(spark, tmp_path):
    spark.createDataFrame([(f"ann{i}@firm.example", f"Ann {i}") for i in range(20)], "email string, name string").write.parquet(f"{tmp_path}/people")
    people = spark.read.parquet(f"{tmp_path}/people")
    assert "/people" not in broadcast(directory.duplicate_people(people))
    assert "/people" not in broadcast(directory.near_keys(people.select(F.concat(F.lit("abcd"), F.substring("name", 5, 9)).alias("key"))))


def test_words_and_their_keys_are_never_broadcast(spark, tmp_path, monkeypatch):
    """Files of words of 8 MB were broadcast with eight keys a word, more than a driver of 750 MB holds."""
    spelling = pytest.importorskip("missiva.llm.spelling")
    made, write = [], spelling.materialize
    monkeypatch.setattr(spelling, "materialize", lambda df, tag: made.append(df) or write(df, tag))
    docs = spark.createDataFrame([(i, f"letters lettrs letter word{'abcdefg'[i % 7]}s") for i in range(40)], "doc_id long, text string")
    got = spelling.variants(docs)
    assert {r.word: (r.form, r.root) for r in got.collect() if r.n_near}["lettrs"] == (None, "lettrs")
    assert len(made) >= 4 and not any(broadcast(df) for df in [*made, got])


def test_codes_that_meet_are_numbered_in_one_pass(spark):
    """Rounds over all firms, each some ten firms further than the last, did not come to an end here."""
    bases = ["AB2" if i % 10 == 7 else "AB22" if i % 10 == 8 else "ABC" if i % 2 == 0 else "AB" for i in range(1, 20001)]
    taken, following, want = set(), {}, []
    for b in bases:
        n = following.get(b, 1)
        while b + (str(n) if n > 1 else "") in taken:
            n += 1
        following[b] = n + 1
        taken.add(want.append(b + (str(n) if n > 1 else "")) or want[-1])
    firms = spark.createDataFrame(list(enumerate(bases)), "first_seen long, code string")
    got = directory.unique_codes(firms)
    assert [r.unique_code for r in got.orderBy("first_seen").collect()] == want


LONG = ("ab_compare", "extract_refs", "evaluation_recall", "evaluation_summary", "floor_details", "floor_recall", "gold_candidates", "gold_zero_miss", "unreconciled_items", "missed_duties")


@pytest.fixture(scope="module")
def long_keys(spark, sf_dir, tmp_path_factory):
    """Tables with keys of eight digits, and their folder."""
    root, con = str(tmp_path_factory.mktemp("long")), duckdb.connect()
    for name, keys in {"orders": ("o_orderkey",), "lineitem": ("l_orderkey", "l_partkey")}.items():
        con.execute(f"create table {name} as select * replace ({', '.join(f'{k} + 12000000 as {k}' for k in keys)}) from '{sf_dir}/{name}.parquet' where {keys[0]} < 800")
        con.execute(f"copy {name} to '{root}/{name}.parquet' (format parquet)")
    return con, root


@pytest.mark.parametrize("name", LONG)
def test_references_made_of_long_keys(spark, long_keys, name):
    import missiva.plans.book_queries  # noqa: F401
    import missiva.plans.record_queries  # noqa: F401
    import missiva.plans.scope_queries  # noqa: F401
    from missiva.plans.queries import QUERIES, SQL

    con, root = long_keys
    assert plain_rows(QUERIES[name](spark, root).toPandas()) == plain_rows(con.sql(SQL[name]).df())


def test_cue_patterns_share_beginnings():
    import random
    import re

    from missiva.functions import text

    rng = random.Random(3)
    for cues in (text.REQUESTS, text.DEADLINES, text.WAIVERS, *text.SENSITIVITY.values()):
        shared, plain = text._quoted(cues), "|".join(map(re.escape, cues))
        said = ["".join(rng.choice(cues)[: rng.randrange(1, 30)] + rng.choice((" ", "x", "")) for _ in range(3)) for _ in range(500)]
        assert all(bool(re.search(shared, s)) == bool(re.search(plain, s)) for s in said)
        assert all(bool(re.search(rf"\b(?:{shared})\b", s)) == bool(re.search(rf"\b(?:{plain})\b", s)) for s in said)
    assert len(text._quoted(text.REQUESTS)) < len("|".join(text.REQUESTS))


def test_signature_and_source_are_worked_out_once(spark):
    from missiva.functions.signature import with_signatures
    from missiva.operators import records

    rows = spark.createDataFrame([("a", "b", ["c"])], "body string, source string, refs array<string>")
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert plan(with_signatures(rows)).count("wrote:") == 1
    assert plan(rows.select(records.grounded(F.col("refs"), F.col("source")).alias("x"))).count("lower(") <= 2


def test_a_bucket_of_threads_is_one_state_with_one_timer():
    import types

    import pandas as pd

    from missiva.streaming import staleness

    kept, timers, calls = [], set(), []
    state = types.SimpleNamespace(get=lambda: kept[-1] if kept else None, update=lambda value: calls.append(kept.append(value)))
    handle = types.SimpleNamespace(getValueState=lambda *_: state, registerTimer=timers.add, deleteTimer=timers.remove)
    bucket = staleness.StaleThreads(1000)
    bucket.init(handle)
    clock = lambda ms: types.SimpleNamespace(getCurrentWatermarkInMs=lambda: ms)
    at = pd.Timestamp("2024-01-01")
    rows = [(f"t{i}", kind, "2024-01-01", n, a, at + pd.Timedelta(seconds=i % 7)) for i in range(1000) for kind, n, a in (("message", None, None), ("record", 1 + i % 2, 0))]
    frame = pd.DataFrame(rows, columns=["thread", "kind", "day", "n", "attach", "at"])
    list(bucket.handleInputRows((0,), iter([frame[:700], frame[700:]]), clock(0)))
    first = int(at.timestamp() * 1000) + 1000
    assert timers == {first} and len(calls) == 1
    timers.clear()
    told = pd.concat(bucket.handleExpiredTimer((0,), clock(first + 3000), types.SimpleNamespace(getExpiryTimeInMs=lambda: first)))
    assert sorted(told["thread"]) == sorted(f"t{i}" for i in range(1000) if i % 2 and i % 7 < 3)
    assert timers == {first + 3000} and len(calls) == 2 and set(told["n"]) == {1}


def test_a_batch_is_made_once_however_full_the_store(spark, tmp_path):
    import uuid

    from missiva.session import scratch_dir
    from missiva.streaming import ingest

    def seen(frames):
        (tmp_path / uuid.uuid4().hex).touch()
        yield from frames

    store = f"{scratch_dir(spark)}/store-{uuid.uuid4().hex}"
    rows = lambda ids: spark.createDataFrame([(i,) for i in ids], "k long").coalesce(1).mapInPandas(seen, "k long")
    ingest.add_once(rows([1, 2, None, None]), ["k"], store, "q", 0, 4)
    assert len(list(tmp_path.iterdir())) == 1
    assert sorted(str(r.k) for r in ingest.add_once(rows([2, 3, 3, None, None]), ["k"], store, "q", 1, 4).collect()) == ["3", "None", "None"]
    assert len(list(tmp_path.iterdir())) == 2


def test_of_an_address_only_the_name_is_parsed():
    from missiva.sources import mail

    letter = lambda i: f"From: =?utf-8?q?A=2C_B?= <X{i}@y.example>\r\nMessage-ID: <{i}@z>\r\nReferences: <{i}@a>\r\n <{i}@b>\r\nSubject: No.\r\n {i}\r\n\r\n".encode()
    before = mail._parsed.cache_info().misses
    rows = [mail.header_row("p", letter(i)) for i in range(100)]
    assert mail._parsed.cache_info().misses - before <= 1
    assert (rows[7]["from"], rows[7]["addrs"], rows[7]["mid"], rows[7]["refs"], rows[7]["subject"]) == ('"A, B" <X7@y.example>', ["x7@y.example"], "7@z", ["7@a", "7@b"], "No. 7")


def test_links_without_an_id_do_not_meet_in_one_task(spark):
    from missiva.operators import links

    known = spark.conf.get("spark.sql.adaptive.enabled"), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = spark.range(4000).select(F.when(F.col("id") % 4 == 0, F.concat(F.lit("m"), "id")).when(F.col("id") % 4 == 1, "").alias("message_id"), F.concat(F.lit("in/"), "id").alias("path"), F.lit("pending").alias("status"))
        members = spark.range(4000).select(F.col("id").cast("string").alias("thread_id"), F.concat(F.lit("m"), "id").alias("message_id"), F.concat(F.lit("in/"), "id").alias("path"))
        plan = links.thread_links(rows, members)
        assert plan.count() == 4000 and plan.agg(F.sum("pending")).first()[0] == 4000
        assert "hashpartitioning(__id" in plan._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", known[0])
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", known[1])


def union_find(edges):
    up = {}

    def top(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None and b is not None:
            a, b = sorted((top(a), top(b)), key=lambda x: x.encode() if isinstance(x, str) else x)
            up[b] = a
    return {x: top(x) for x in up}


@pytest.mark.parametrize("kind", ["string", "date"])
def test_components_by_chunks_are_those_of_union_find(spark, kind):
    import datetime
    import random

    from missiva.operators.components import connected_components, extend_components

    rng = random.Random(11)
    name = {"string": lambda i: rng.choice(("é", "z", "\U0001f600", "￮")) + str(i) if i % 2 else f"n{i}", "date": lambda i: datetime.date(2024, 1, 1) + datetime.timedelta(days=i)}[kind]
    names = [name(i) for i in range(120)]
    edges = [(rng.choice(names), rng.choice(names)) for _ in range(70)] + [(names[50], None), (None, None), (names[119], names[119])]
    rng.shuffle(edges)
    frame = lambda rows: spark.createDataFrame(rows, f"src {kind}, dst {kind}").repartition(3)
    parts = lambda df: {r.node: r.component for r in df.collect()}
    first = connected_components(frame(edges[:50]), together=True)
    assert parts(first) == union_find(edges[:50])
    grown = extend_components(first, frame(edges[50:]))
    assert parts(grown) == union_find(edges) and grown.count() == len(union_find(edges))
    assert parts(connected_components(frame([]), together=True)) == {}


def test_a_task_contracts_its_edges_in_bounded_chunks(monkeypatch):
    import pyarrow as pa

    from missiva.operators import components

    batch = lambda *e: pa.RecordBatch.from_arrays([pa.array([a for a, _ in e]), pa.array([b for _, b in e])], names=["node", "root"])
    batches = [batch(("d", "c"), ("b", "c")), batch(("b", "a")), batch(("x", "d"), ("y", "y"))]
    stars = lambda: sorted((r["node"], r["root"]) for b in components._stars(iter(batches)) for r in b.to_pylist())
    assert stars() == [("a", "a"), ("b", "a"), ("c", "a"), ("d", "a"), ("x", "a"), ("y", "y")]
    monkeypatch.setattr(components, "CHUNK", (3, 1 << 24))
    assert stars() == [("a", "a"), ("b", "a"), ("c", "a"), ("d", "a"), ("d", "d"), ("x", "d"), ("y", "y")]
    chain = components._roots(*(lambda x: (x[:-1], x[1:]))(np.random.default_rng(1).permutation(50_000)), 50_000)
    assert not chain.any()


def test_threads_that_lie_together_need_no_rounds(spark, monkeypatch):
    from missiva.operators import components, threads

    made, real = [], components.materialize
    monkeypatch.setattr(components, "materialize", lambda df, tag: made.append(tag) or real(df, tag))
    mail = spark.range(0, 400, 1, 4).select(F.col("id").alias("ordinal"), F.concat(F.lit("m"), "id").alias("message_id"), F.when(F.col("id") % 4 > 0, F.concat(F.lit("m"), F.col("id") - 1)).alias("reply_to"))
    assert threads.link_threads(mail).select("component").distinct().count() == 100
    assert made == ["stars"]
    labels = components.connected_components(mail.selectExpr("message_id as src", "coalesce(reply_to, message_id) as dst").where("src <> 'm6'"), together=True)
    made.clear()
    grown = components.extend_components(labels, spark.createDataFrame([("n1", "m0"), ("n2", "n1")], "src string, dst string").coalesce(1))
    assert made == ["stars"] and grown.count() == labels.count() + 2 and not grown.where("node like 'n%' and component <> 'm0'").count()


def test_rollups_shuffle_each_message_once(spark):
    from missiva.operators import threads

    rows = spark.createDataFrame([("a", "x", "2024", 1, "s", "f"), ("a", "y", None, 2, "t", "f"), ("a", None, "2023", 3, None, None)], "component string, message_id string, sent_day string, ordinal long, sender string, folder string")
    got = threads.thread_rollup(rows)
    assert "Expand" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert [(f.name, f.dataType.typeName()) for f in got.schema if f.name in ("participants", "folders")] == [("participants", "long"), ("folders", "long")]
    assert [(r.n, r.participants, r.folders) for r in got.collect()] == [(3, 2, 1)]
    members = rows.withColumns({"has_attach": F.lit(True), "locations": F.array("ordinal")})
    rolled = threads.member_rollup(members, F.max(F.size("locations")).alias("places"))
    assert [(r.n, r.places) for r in rolled.collect()] == [(3, 1)]
    plan = rolled._jdf.queryExecution().sparkPlan().toString()
    assert plan.index("partial_collect_set") < plan.index("REPARTITION_BY_COL")


def test_names_of_threads_are_followed_once(spark):
    from missiva.operators import history

    made = lambda text: spark.createDataFrame([], text)
    got = history.threads_with_records(
        made("component string, thread_id string, n long, last_day string"), made("thread_id string, version int, n long, last_day string"), made("thread_id string, component string, version int"), made("node string, component string")
    )
    assert got._jdf.queryExecution().analyzed().toString().count("LogicalRDD") == 4


def test_duties_are_found_by_few_patterns_in_tasks_of_one_size(spark, sf_dir, monkeypatch):
    """All rows of a row group were one task, and each sentence was searched by a pattern a class."""
    from missiva import session
    from missiva.plans.record_queries import missed_duties

    monkeypatch.setitem(session.spread.__kwdefaults__, "per_partition", 500)
    df = missed_duties(spark, sf_dir)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "obligated" not in plan
    sizes = df.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    assert len(sizes) >= 10 and max(sizes) < 1000


def test_cues_of_sentences_equal_those_of_words(spark):
    import random

    from missiva.functions import atoms, text

    rng = random.Random(5)
    odd = ["FİLL IN", "Kindly", "İs it", "dó it", "do_it", "DOES it", "\t x ", "ab", "１４．06.2026", "2025-02-31", "2025年3月9日", "14 Mar 2025", "May 2020", "1.2.19", "On Mon wrote: 1/2/2024"]
    cues = [w for words in text.CUES.values() for w in words]
    said = ["".join(rng.choice((*cues, *odd)).upper() + rng.choice((" ", ". ", "！", "\n", "?")) for _ in range(rng.randrange(9))) for _ in range(300)]
    rows = spark.createDataFrame([(s,) for s in [*said, None, ""]], "t string")
    t = F.col("t")
    for got, s in ((r.x, r.s) for r in rows.select(text.cued_sentences(t).alias("x"), text.sentences(t).alias("s")).collect()):
        assert [x.s for x in got] == s
        for x in got:
            low = x.s.replace("İ", "i̇").lower()
            assert [x.cues >> k & 1 for k in range(len(text.CUES))] == [int(any(low.startswith(w) if kind == "lead" else w in low for w in words)) for kind, words in text.CUES.items()]
    dated = F.transform(text.cued_sentences(t), lambda x: F.struct(text._has(x, "date").alias("hint"), (F.size(atoms.extract_dates(x["s"])) > 0).alias("dated")))
    found = [x for r in rows.select(dated.alias("d")).collect() for x in r.d]
    assert all(x.hint for x in found if x.dated) and any(x.dated for x in found) and not all(x.hint for x in found)
