"""Token counts and the BPE codec against the tokenizers library."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from missiva.llm import bpe_codec, token_count
from missiva.llm.bpe import forest

COUNT, CODE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
AWKWARD = [
    "", " ", "  a", "a  b \n c", "it's I'll we've 'rex 're 'r 'ld don't ' 's  'sx", "<|endoftext|>hi<|endoftext|> <|endoftext|>", "a<|startoftext|>B<|x|>", "ΑΣ Σ ΟΔΟΣ İx", "é café",
    "日本語 テスト １２３ 12345", "\x1c\x1d a\x1fb \x85 \xa0 x", "　", "!!!???...   \n\n\n  x", "a" * 3000, "ab" * 500 + " " * 300, "😀👍🏽", "Ⅷ ² ½ x²",
]


@pytest.fixture(scope="module")
def texts(spark, sf_dir):
    rng = random.Random(1)
    made = ["".join(rng.choice("ab'slrevt \n\t1é日.<|!") for _ in range(rng.randint(0, 300))) for _ in range(300)]
    return AWKWARD + made + [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()]


def test_counts(texts):
    want = [len(x.ids) for x in Tokenizer.from_file(COUNT).encode_batch(texts, add_special_tokens=False)]
    counter = token_count.TokenCounter(COUNT)
    got = np.concatenate([counter(texts[s]) for s in token_count.slices(texts, 5000)])
    assert got.tolist() == want


def test_chunk_maps_compose():
    splitter = token_count.Splitter()
    text = "it's  a\n\n test 12ab !? 've" * 200
    codes = np.frombuffer(text.encode("utf-32-le"), dtype="<u4")
    at = splitter.starts(codes, np.array([len(text)]))
    old, token_count.CHUNK = token_count.CHUNK, 7
    try:
        assert splitter.starts(codes, np.array([len(text)])).tolist() == at.tolist()
    finally:
        token_count.CHUNK = old


def test_codec(texts):
    library = Tokenizer.from_file(CODE)
    codec = bpe_codec.Codec(CODE)
    want = [x.ids for x in library.encode_batch(texts, add_special_tokens=False)]
    got = [codec.encode(t) for t in texts]
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == want
    assert [bytes(d).decode() for d in codec.decode(got)] == library.decode_batch(want, skip_special_tokens=False)


def test_compatibility_is_what_merging_does():
    vocabulary = forest(COUNT)
    library = Tokenizer.from_file(COUNT)
    names = {i: vocabulary.names[i] for i in (64, 300, 465, 1119, 262, 290)}
    plain = {i: vocabulary.spelled[i].encode("latin-1").decode("utf-8", "ignore") for i in names}
    for a in names:
        for b in names:
            if plain[a].strip() and plain[b].strip() and " " not in plain[b]:
                assert vocabulary.compatible(a, b) == (library.encode(plain[a] + plain[b]).ids == [a, b])


def test_rows(spark):
    df = spark.createDataFrame([(1, "Hello there", 5), (1, "Hello there", 5), (None, None, 6), (3, "", None)], "doc_id long, text string, n_tokens int")
    got = sorted(map(tuple, token_count.count_tokens(df, COUNT, limit=1).collect()), key=repr)
    assert got == sorted([(1, 11, 2, True), (1, 11, 2, True), (None, 0, 0, False), (3, 0, 0, False)], key=repr)
    assert token_count.count_tokens(df.limit(0), COUNT).count() == 0
    empty = hashlib.sha256(b"").hexdigest()
    rows = bpe_codec.encode_documents(df, CODE).collect()
    assert [(r.n_tokens, r.ids_sha256, r.decoded_sha256, r.decoded) for r in rows if r.doc_id != 1] == [(0, empty, empty, "")] * 2
    assert [r.decoded for r in rows if r.doc_id == 1] == ["hello</w> there</w>"] * 2
    assert bpe_codec.encode_documents(df.limit(0), CODE).count() == 0
