"""Mixing, WARC, permutation index and the pipeline."""

import base64
import hashlib

import numpy as np
from duck import connect, rows
from pyspark.sql import functions as F

from missiva.llm import mixing, permutation_index, queries, warc
from missiva.session import scratch_dir


def test_mixing_matches_sql(spark, sf_dir):
    got = queries.QUERIES["op5_mixing"](spark, sf_dir).toPandas()
    assert rows(got) == rows(connect(sf_dir).sql(mixing.SQL).df())


def test_shortage_goes_to_siblings_first(spark):
    data = [(i, "w " * 10, "en", "a" if i < 2 else "b") for i in range(12)] + [(20 + i, "w " * 10, "fr", "c") for i in range(12)]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, source string")
    taken = mixing.mix_sources(docs, percent=50, epochs=1, domain=F.lit("d")).groupBy("source").agg(F.sum("n_tokens").alias("n"))
    # 120 tokens: 60 a language; source a can give 20 of its 30, its sibling b takes the rest
    assert {r.source: r.n for r in taken.collect()} == {"a": 20, "b": 40, "c": 60}
    twice = mixing.mix_sources(docs, percent=200, epochs=2, domain=F.lit("d"))
    assert twice.count() == 48
    weighted = mixing.mix_sources(docs, percent=50, epochs=1, domain=F.lit("d"), weights={"lang": {"fr": 2}}).groupBy("lang").agg(F.sum("n_tokens").alias("n"))
    assert {r.lang: r.n for r in weighted.collect()} == {"en": 40, "fr": 80}


def test_mixing_awkward(spark):
    docs = spark.createDataFrame([(None, None, None, None, 1), (1, "", "en", "s", 2), (2, "a b", "en", "s", 3), (2, "a b", "en", "s", 3)], "doc_id long, text string, lang string, source string, epoch int")
    assert mixing.mix_sources(docs, percent=100, epochs=1).count() <= 4
    assert mixing.mix_sources(docs.limit(0)).count() == 0
    assert mixing.keep_mixed(docs, percent=100).columns == docs.columns


def test_warc_matches_sql(spark, sf_dir):
    got = queries.QUERIES["op9_warc"](spark, sf_dir).toPandas()
    assert rows(got) == rows(connect(sf_dir).sql(warc.SQL).df())


def test_warc_awkward(spark):
    nested = "WARC/1.1\r\nWARC-Type: response\r\n\r\n\r\n\r\nWARC/1.1\r\n"
    pages = [(1, "http://a/", "<p>x</p>"), (2, "http://b/", "<p>x</p>"), (3, "http://c/", nested), (None, None, None), (4, "http://d/", ""), (5, "http://e/\r\nX: y", "é\r\n\r\n"), (5, "http://e/\r\nX: y", "é\r\n\r\n")]
    df = spark.createDataFrame([(*p, "extra") for p in pages], "page_id long, url string, html string, payload_bytes string")
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.archive_pages(df).collect()), key=repr)
    digest = lambda t: base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
    kinds = {1: ("revisit", 2), None: ("revisit", 4)}
    want = [(p, len((t or "").encode()), digest(t), *kinds.get(p, ("response", None))) for p, _, t in pages]
    assert got == sorted(want, key=repr)
    small = {r.page_id: r.record_type for r in warc.archive_pages(df, min_bytes=1).collect()}
    assert small[None] == "response" and small[1] == "revisit"
    assert warc.archive_pages(df.limit(0)).count() == 0


def test_captures_are_nested_and_whole(spark):
    df = spark.createDataFrame([(1, "http://a/x?y", "<p>1</p>"), (2, "http://b/", "<p>1</p>")], "page_id long, url string, html string")
    path = f"{scratch_dir(spark)}/warc-test-{id(df)}"
    warc.write_archives(df, path)
    records = warc.read_records(spark, path, with_payload=True)
    assert sorted(r.kind for r in records.collect()) == ["metadata", "metadata", "request", "request", "response", "revisit"]
    captures = {r.metadata.page_id: r for r in warc.assemble(records).collect()}
    assert bytes(captures[2].response.payload) == b"<p>1</p>" and captures[2].response.digest_ok and captures[1].response.refers_to == captures[2].capture_id
    assert captures[1].request.target_uri == "http://a/x?y"
    alone = {r.capture_id: r.metadata for r in warc.assemble(records.where("kind <> 'metadata'")).collect()}
    assert set(alone.values()) == {None}


def exact(ids, x, every, k):
    out = {}
    for i, v in zip(ids, x):
        if i % every == 0:
            scores = x @ v
            order = [j for j in np.lexsort((ids, -scores)) if ids[j] != i][:k]
            out[int(i)] = [int(ids[j]) for j in order]
    return out


def test_recall(spark):
    sf = "/root/testdata/sf0.1"
    df = spark.read.parquet(f"{sf}/embeddings.parquet").toPandas()
    want = exact(df.vec_id.to_numpy(), np.array(list(df.embedding), dtype=float), 20, 20)
    got = queries.QUERIES["op6_permutation_index"](spark, sf).toPandas().groupby("query_id").vec_id.apply(set)
    assert np.mean([len(got[q] & set(ids)) / 20 for q, ids in want.items()]) > 0.93


def test_few_vectors_are_all_found_in_order(spark):
    data = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.5, 0.5]), (3, None), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [-1.0, 0.0]), (None, [1.0, 1.0]), (20, [2.0, 0.0]), (21, [1.0, None])]
    df = spark.createDataFrame([(*d, 1) for d in data], "vec_id long, embedding array<double>, rank int")
    got = [(r.query_id, r.rank, r.vec_id, r.score) for r in permutation_index.search(df).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 20, 2.0), (0, 2, 1, 0.5), (0, 3, 2, 0.5), (0, 4, 6, -1.0), (20, 1, 0, 2.0), (20, 2, 1, 1.0), (20, 3, 2, 1.0), (20, 4, 6, -2.0)]
    assert permutation_index.search(df.limit(0)).count() == 0


def test_pipeline(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    start = docs.count()
    out = corpus_pipeline.run(spark, sf_dir).toPandas()
    assert 0 < len(out) < start and out.doc_id.is_unique
    assert (out.ids.str.len() == 4 * out.n_tokens).all()
    assert all(hashlib.sha256(i).hexdigest() == s for i, s in zip(out.ids, out.ids_sha256))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "suffix_dedup", "mixing", "bpe"]


def test_repeated_query_rows(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(200, 8))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [rows[20], rows[20], rows[7], (40, x[41].tolist()), (None, x[0].tolist())]
    got = permutation_index.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    lists = {}
    for r in got:
        lists.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert {q: len(v) for q, v in lists.items()} == {q: 40 if q == 40 else 20 for q in range(0, 200, 20)}
    assert len({v for _, v, _ in lists[20]}) == 20
    every = [(i, v) for i, v in rows[:200]] + [(40, x[41].tolist())]
    for query in (x[40], x[41]):
        want = sorted(((-float((query * np.array(v)).sum()), i) for i, v in every if i != 40))[:20]
        assert {i for _, i in want} <= {v for _, v, _ in lists[40]}


def test_archives_of_several_members(spark, tmp_path):
    import gzip

    record = lambda i: f"WARC/1.1\r\nWARC-Type: request\r\nWARC-Record-ID: <urn:{i}>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n".encode()
    (tmp_path / "part-1.warc.gz").write_bytes(b"".join(gzip.compress(record(i)) for i in range(300)))
    (tmp_path / "part-2.warc.gz").write_bytes(gzip.compress(record(300) + record(301)))
    assert sorted(r.record_id for r in warc.read_records(spark, str(tmp_path)).collect()) == sorted(f"urn:{i}" for i in range(302))
    big = gzip.compress(b"x" * 300_000) + gzip.compress(np.random.default_rng(1).bytes(200_000)) + gzip.compress(b"")
    assert len(warc.unpacked(big)) == 500_000 and warc.unpacked(big, 7) == warc.unpacked(big)
