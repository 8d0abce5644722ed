"""Streams and stores: exactly-once keys, versions, stale threads, incremental headers."""

import uuid
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from missiva.session import scratch_dir
from missiva.sources import manifest, tables
from missiva.streaming import ingest, staleness


@pytest.fixture
def base(spark):
    return f"{scratch_dir(spark)}/t-{uuid.uuid4().hex}"


def ingest_all(spark, base, schema, keys, checkpoint, then=None):
    landing = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 2).parquet(f"{base}/in")
    ingest.stream_once(landing, keys, f"{base}/store", f"{base}/{checkpoint}", then, buckets=4).awaitTermination()
    return ingest.read_store(spark, f"{base}/store", schema)


def test_stream_takes_each_key_once(spark, base):
    rows = spark.range(200).select(F.col("id").alias("k"), (F.col("id") % 7).alias("v"))
    seen = []
    then = lambda df: seen.append(df.count())
    rows.where("k < 120").write.parquet(f"{base}/in/a")
    assert ingest_all(spark, base, rows.schema, "k", "cp", then).count() == 120
    rows.where("k > 80").write.parquet(f"{base}/in/b")
    got = ingest_all(spark, base, rows.schema, "k", "cp", then)
    assert got.count() == 200 and got.select("k").distinct().count() == 200 and sum(seen) == 200


def test_a_fresh_checkpoint_loses_nothing(spark, base):
    schema = "k long"
    spark.createDataFrame([(1,), (2,), (3,)], schema).coalesce(1).write.parquet(f"{base}/in/a")
    first = ingest_all(spark, base, spark.createDataFrame([], schema).schema, "k", "cp1")
    assert sorted(r.k for r in first.collect()) == [1, 2, 3]
    spark.createDataFrame([(4,), (2,)], schema).coalesce(1).write.parquet(f"{base}/in/b")
    assert sorted(r.k for r in ingest_all(spark, base, first.schema, "k", "cp2").collect()) == [1, 2, 3, 4]


def test_composite_keys_and_rows_without_one(spark, base):
    schema = "folder string, validity long, key long, note string, `__bucket` int"
    rows = [("A", 1, 1, "x", 9), ("A", 1, 1, "y", 9), ("A", 2, 1, "x", 9), ("B", 1, 1, "x", 9), ("A", None, 1, "x", 9), ("A", None, 1, "x", 9)]
    df = spark.createDataFrame(rows, schema).drop("__bucket")
    df.coalesce(1).write.parquet(f"{base}/in/a")
    keys = ["folder", "validity", "key"]
    assert ingest_all(spark, base, df.schema, keys, "cp").count() == 5
    df.where("validity is not null").coalesce(1).write.parquet(f"{base}/in/b")
    assert ingest_all(spark, base, df.schema, keys, "cp").count() == 5


def test_a_batch_run_again_is_added_once(spark, base):
    store, batch = f"{base}/store", spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "k long, v string")
    first = sorted(map(str, ingest.add_once(batch, ["k"], store, "q", 0).collect()))
    again = sorted(map(str, ingest.add_once(batch, ["k"], store, "q", 0).collect()))
    assert first == again and len(first) == 3 and ingest.read_store(spark, store, batch.schema).count() == 3
    batch.write.parquet(f"{store}/__part=left-by-a-failed-attempt")
    assert ingest.add_once(batch, ["k"], store, "q", 1).count() == 1  # the row without a key
    assert ingest.add_once(batch.limit(0), ["k"], store, "q", 2).count() == 0
    assert ingest.read_store(spark, store, batch.schema).count() == 4
    assert ingest.compact_store(spark, store, batch.schema) and len(manifest.last_entry(spark, store)[1]["parts"]) == 2
    assert ingest.read_store(spark, store, batch.schema).count() == 4 and ingest.add_once(batch, ["k"], store, "r", 0).count() == 1


def test_two_writers_of_one_store(spark, base, monkeypatch):
    store, schema = f"{base}/store", "k long, v string"
    mine, other = spark.createDataFrame([(1, "mine"), (2, "mine"), (None, "mine")], schema), spark.createDataFrame([(2, "other"), (3, "other")], schema)
    plain, raced = manifest.add_entry, []

    def late(spark, root, number, state):
        if not raced:  # another writer commits between this writer's look and its commit
            raced.append(1)
            assert ingest.add_once(other, ["k"], store, "other", 0).count() == 2
        return plain(spark, root, number, state)

    monkeypatch.setattr(ingest, "add_entry", late)
    assert sorted((r.k is None, r.k or 0) for r in ingest.add_once(mine, ["k"], store, "mine", 0).collect()) == [(False, 1), (True, 0)]
    assert sorted((r.v, r.k or 0) for r in ingest.read_store(spark, store, mine.schema).collect()) == [("mine", 0), ("mine", 1), ("other", 2), ("other", 3)]


def test_two_writers_of_one_table(spark, base):
    root = f"{base}/table"
    tables.write_version(spark.range(3), root)
    stale = tables.version_number(spark, root)
    tables.write_version(spark.range(5), root, stale)
    with pytest.raises(tables.Outdated):
        tables.write_version(spark.range(9), root, stale)
    assert tables.read_version(spark, root).count() == 5
    assert not manifest.add_entry(spark, root, stale, {"version": "x"})
    raced = []

    def add_row(current):
        if not raced:  # somebody else changes the table while this change is made
            raced.append(1)
            tables.change_version(spark, root, lambda df: df.unionAll(spark.range(100, 101)))
        return current.unionAll(spark.range(200, 201))

    tables.change_version(spark, root, add_row)
    assert sorted(r.id for r in tables.read_version(spark, root).collect()) == [0, 1, 2, 3, 4, 100, 200]
    with pytest.raises(ValueError):
        tables.read_version(spark, f"{base}/none")


def test_one_of_many_writers_makes_an_entry(spark, base):
    with ThreadPoolExecutor(6) as pool:
        won = list(pool.map(lambda i: manifest.add_entry(spark, base, 1, {"by": i}), range(6)))
    assert sum(won) == 1 and manifest.last_entry(spark, base) == (1, {"by": won.index(True)})


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.unset(key)


def test_stale_threads_are_told_of_once(rocks, base):
    spark, schema = rocks, "thread string, kind string, day string, n long, attach long, at string"
    waves = [
        [("a", "message", "2024-01-02", None, None, 1), ("a", "record", "2024-01-02", 1, 0, 2), ("b", "message", "2024-01-02", None, None, 1), ("c", "record", "2024-01-05", 0, 0, 1), (None, "message", "x", None, None, 1)],
        [("a", "message", "2024-01-01", None, None, 3), ("a", "message", None, None, None, 3), ("b", "message", "2024-01-09", None, None, 3), ("d", "message", "2024-01-01", None, None, 3), ("d", "record", "2024-01-01", 1, 0, 4)],
        [("z", "message", "2024-01-01", None, None, 20)],
        [("a", "message", "2024-01-03", None, None, 21), ("a", "record", "2024-01-03", 4, 0, 22), ("d", "file", None, None, None, 21)],
        [("z", "message", "2024-01-01", None, None, 60)],
    ]
    told = []
    for i, wave in enumerate(waves):
        rows = [(t, k, d, n, a, f"2024-02-{at:02d}" if at < 29 else "2024-04-01") for t, k, d, n, a, at in wave]
        spark.createDataFrame(rows, schema).withColumn("at", F.to_timestamp("at")).coalesce(1).write.parquet(f"{base}/in/{i}")
        events = spark.readStream.schema(schema.replace("at string", "at timestamp")).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
        seen = lambda df, n: told.extend((i, *r) for r in df.collect())
        staleness.stale_stream(events, 3600).writeStream.foreachBatch(seen).option("checkpointLocation", f"{base}/cp").trigger(availableNow=True).start().awaitTermination()
    assert [t for t in told if t[1] == "a"] == [(2, "a", 3, "2024-01-02", 0)]
    assert [t for t in told if t[1] == "c"] == [(2, "c", 0, "", 0)]
    assert [t for t in told if t[1] == "d"] == [(4, "d", 1, "2024-01-01", 1)]
    assert {t[1] for t in told} == {"a", "c", "d"}


def letter(subject, i=1):
    return f"From: Ann <ann@firm.example>\r\nTo: b@x.example\r\nMessage-ID: <M{i}@x>\r\nIn-Reply-To: <P@x>\r\nDate: Mon, 01 Jan 2024 10:00:00 +0800\r\nSubject: {subject}\r\n\r\nHello.\r\n".encode()


def post(spark, root, letters):
    rows = [(folder, validity, key, letter(subject, key)) for folder, validity, key, subject in letters]
    spark.createDataFrame(rows, "folder string, validity long, key long, raw binary").write.format("mailbox").mode("append").save(root)


def test_mailbox_reads_what_is_asked_for(spark, base):
    from missiva.sources import mailbox

    mailbox.register(spark)
    post(spark, base, [("INBOX", 7, 1, "one"), ("INBOX", 7, 12, "two"), ("Sent", 3, 2, "three")])
    with open(f"{base.removeprefix('file://')}/Sent/3/x.eml", "wb") as f:
        f.write(b"no number")
    box = spark.read.format("mailbox").load(base)
    assert sorted((r.folder, r.validity, r.key, r.mid, r.subject, r.refs, r.addrs) for r in box.collect()) == [
        ("INBOX", 7, 1, "m1@x", "one", ["p@x"], ["ann@firm.example", "b@x.example"]), ("INBOX", 7, 12, "m12@x", "two", ["p@x"], ["ann@firm.example", "b@x.example"]), ("Sent", 3, 2, "m2@x", "three", ["p@x"], ["ann@firm.example", "b@x.example"]),
    ]
    assert sorted(r.subject for r in box.where("folder = 'INBOX' and key > 1").collect()) == ["two"] and box.where("folder in ('Sent', 'x')").count() == 1
    reader = mailbox.Reader(base, ["key"])
    assert list(reader.pushFilters([mailbox.EqualTo(("folder",), "Sent")])) == [] and [m.key for p in reader.partitions() for m in p.files] == [2]
    with open(f"{base.removeprefix('file://')}/Sent/3/2.eml", "wb") as f:
        f.write(b"\xff\xfe no header")
    keys = spark.read.format("mailbox").schema("folder string, key long").load(base)
    assert sorted(map(tuple, keys.collect())) == [("INBOX", 1), ("INBOX", 12), ("Sent", 2)]
    assert spark.read.format("mailbox").load(f"{base}/none").count() == 0


def test_a_second_run_opens_new_messages_only(spark, base):
    from missiva.sources import mailbox

    mailbox.register(spark)
    root, opened = f"{base}/box", []

    def run():
        found = spark.readStream.format("mailbox").schema("folder string, validity long, key long, subject string").load(root)
        ingest.stream_once(found, ["folder", "validity", "key"], f"{base}/store", f"{base}/cp", lambda df: opened.append(df.count())).awaitTermination()
        return sorted(map(tuple, ingest.read_store(spark, f"{base}/store", found.schema).collect()))

    post(spark, root, [("INBOX", 7, 1, "one"), ("INBOX", 7, 2, "two"), ("Sent", 3, 9, "nine")])
    assert len(run()) == 3
    post(spark, root, [("INBOX", 7, 1, "changed"), ("Sent", 3, 9, "changed"), ("INBOX", 7, 10, "ten"), ("New", 1, 1, "new"), ("Sent", 4, 1, "again")])
    want = [("INBOX", 7, 1, "one"), ("INBOX", 7, 2, "two"), ("INBOX", 7, 10, "ten"), ("New", 1, 1, "new"), ("Sent", 3, 9, "nine"), ("Sent", 4, 1, "again")]
    assert run() == sorted(want) and sum(opened) == 6
    assert run() == sorted(want) and sum(opened) == 6
    stream = mailbox.StreamReader(root, ["subject"])
    end = stream.latestOffset()
    assert end == {"INBOX": [7, 10], "New": [1, 1], "Sent": [4, 1]}
    assert sorted(m.key for p in stream.partitions({"INBOX": [7, 2], "New": [1, 1], "Sent": [4, 1]}, end) for m in p.files) == [10]


def test_both_histories_of_merged_threads_are_found(spark):
    from missiva.operators import history
    from missiva.operators.components import connected_components, extend_components

    edges = lambda *e: spark.createDataFrame(e, "src string, dst string")
    old = connected_components(edges(("b", "b2"), ("d", "d2"), ("x", "x")))
    new = extend_components(old, edges(("b2", "a"), ("a", "d2"), ("y", "y")))
    assert sorted(map(tuple, history.label_changes(old, new, 2).collect())) == [("b", "a", 2), ("d", "a", 2)]
    rollup = lambda rows: spark.createDataFrame(rows, "component string, thread_id string, n long, last_day string")
    log = history.name_log(rollup([("b", "B", 2, "1"), ("d", "D", 2, "1"), ("x", "X", 1, None), ("gone", "G", 1, "1")]), 1)
    records = spark.createDataFrame([("B", 1, 2, "1"), ("D", 1, 2, "1"), ("D", 0, 1, "1"), ("X", 1, 1, None), ("G", 1, 1, "1"), ("unknown", 1, 1, "1"), (None, 1, 1, "1")], "thread_id string, version int, n long, last_day string")
    now = rollup([("a", "BD", 5, "2"), ("x", "X", 1, None), ("y", "Y", 1, "3")])
    got = history.threads_with_records(now, records, log, new).select("thread_id", "n_names", "n_records", "record_id", "state").collect()
    assert sorted(map(tuple, got)) == [("BD", 2, 3, "D", "stale"), ("X", 1, 1, "X", "done"), ("Y", 0, 0, None, "pending")]
    assert history.threads_with_records(now.limit(0), records.limit(0), log.limit(0), new.limit(0)).count() == 0
