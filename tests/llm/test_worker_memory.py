"""What Python workers keep when their task is over."""

import public_tokenizers
import pyarrow as pa

from missiva import session
from missiva.llm import bpe_codec, near_dup, suffix_dedup, toxicity


def test_tasks_leave_no_words_behind(spark):
    docs = spark.createDataFrame([(i, f"nothing like word{i} or other{i % 7}") for i in range(60)], "doc_id long, text string").coalesce(1)
    path = public_tokenizers.path("word_bpe_49k.json")

    def left(batches):
        for batch in batches:
            codec = bpe_codec._codec(path)
            yield pa.RecordBatch.from_arrays([pa.array([len(codec.ids) + len(codec.ids.encoder.vocabulary._fits)])], names=["n"])

    assert bpe_codec.encode_documents(docs, path).count() == 60
    assert [r.n for r in spark.range(1).coalesce(1).mapInArrow(left, "n long").collect()] == [0]


def test_another_operator_drops_what_is_held():
    for key in ("a", "b"):
        assert session.held(key, lambda: [key]) == [key]
    assert session.held("b", list) == ["b"] and list(session._HELD) == ["b"]
    scorer = toxicity.Scorer(toxicity.Network())
    scorer.net.prior = 0.1
    before = scorer(["some words", ""]).tolist()
    scorer.forget()
    assert len(scorer.lexicon.number) == 1 and not sum(map(len, scorer.tables)) and scorer(["some words", ""]).tolist() == before
    ended = []
    assert list(session.lean(lambda batches: (b + 1 for b in batches), lambda: ended.append(1))([1, 2])) == [2, 3] and ended == [1]


def test_batches_are_small(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.unset(key)
    try:
        near_dup.near_duplicates(spark.createDataFrame([(1, "a b c d e f"), (2, "g h")], "doc_id long, text string")).count()
        rows = spark.range(20, numPartitions=1).selectExpr("repeat('x', 500000) as text")
        most = lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["n"]) for b in batches)
        assert max(r.n for r in rows.mapInArrow(most, "n long").collect()) < 3_000_000
    finally:
        spark.conf.set(key, before)
    assert suffix_dedup.BLOCK <= 500_000
