"""Suffix-array dedup and near-duplicate classes against brute force."""

import collections
import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from missiva.llm import near_dup, suffix_dedup


def trimmed(rows):
    first, out = {}, {}
    for doc, text in sorted(rows):
        raw = text.encode()
        gone = bytearray(len(raw))
        for q in range(len(raw) - 99):
            if first.setdefault(raw[q : q + 100], (doc, q)) != (doc, q):
                gone[q : q + 100] = b"\1" * 100
        left = bytes(b for b, g in zip(raw, gone) if not g)
        runs = sum(1 for j, g in enumerate(gone) if g and (j == 0 or not gone[j - 1]))
        out[doc] = (len(raw), len(raw) - len(left), runs, hashlib.sha256(left).hexdigest())
    return out


def test_repeats(spark):
    rng = random.Random(2)
    base = "".join(rng.choice("abcdé ") for _ in range(2000))
    noise = lambda n: "".join(rng.choice("xyz") for _ in range(n))
    rows = []
    for i in range(80):
        a = rng.randint(0, 1500)
        edited = list(base[:900])
        edited[rng.randint(0, 899)] = "#"
        rows.append((i, rng.choice([base[a : a + 700], "ab" * rng.randint(0, 200), "x" * rng.randint(0, 300), noise(rng.randint(0, 80)) + base[a : a + rng.randint(90, 130)] + noise(50), "".join(edited), noise(200)])))
    got = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got.collect()} == trimmed(rows)


def test_long_texts_are_cut_into_overlapping_stretches():
    text = "".join(random.Random(1).choice("ab cd") for _ in range(5000)).encode()
    old, suffix_dedup.BLOCK = suffix_dedup.BLOCK, 700
    try:
        starts = np.concatenate([np.repeat(low, more + 1) for _, _, _, low, more in suffix_dedup.samples([b"short", text])])
    finally:
        suffix_dedup.BLOCK = old
    assert len(starts) == 5000 - 99


def test_a_task_that_starts_inside_a_rank_opens_it():
    names = ["core", "stretch", "doc", "seq", "start", "more"]
    batch = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=names)
    one, next_rows = [(5, 1, d, 0, 0, 3) for d in range(4)], [(6, 1, 9, 0, 0, 3), (7, 1, 9, 0, 8, 3), (8, 1, 9, 0, 9, 3)]
    for batches in ([one, next_rows], [one[:2], one[2:], next_rows], [one + next_rows], [one[:1], one[1:] + next_rows[:2], next_rows[2:]]):
        runs = list(suffix_dedup._groups(map(batch, batches), names))
        assert [x[1] for x in runs] == [True] + [False] * (len(runs) - 1) and [x[2] for x in runs] == [False] * (len(runs) - 1) + [True]
        assert all(len(g["core"]) for g, _, _ in runs) and sum(len(g["core"]) for g, _, _ in runs) == 7
        got = [r for b in suffix_dedup._round_one(map(batch, batches)) for r in b.to_pylist()]
        assert {(r["doc"], r["start"], r["open"]) for r in got} == {(0, 0, True), (1, 0, False), (2, 0, False), (3, 0, False), (9, 9, True)}


def test_repeats_awkward(spark):
    p = "0123456789" * 30
    rows = [(2, p, "k"), (2, p, "k"), (1, "q" + p, None), (None, None, None), (None, p, "n"), (3, "", "e"), (7, "é" * 80, None), (7, "other " * 3, "o")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_bytes string").withColumn("lang", F.lit("en"))
    got = suffix_dedup.remove_repeats(df, keep=("lang",), with_text=True)
    out = sorted((r.doc_id, r.n_bytes, r.n_removed) for r in got.collect() if r.doc_id is not None)
    # the null id comes first, so everything else that repeats its digits goes
    assert (2, 300, 300) in out and out.count((2, 300, 300)) == 2 and (1, 301, 300) in out and (3, 0, 0) in out and (7, 18, 0) in out
    assert len(got.collect()) == 8 and suffix_dedup.remove_repeats(df.limit(0)).count() == 0


def shingle_bag(text):
    w = (text or "").split()
    return collections.Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else collections.Counter()


def class_of(rows):
    bags, parent = [shingle_bag(t) for _, t in rows], list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(bags):
        for j in range(i):
            b = bags[j]
            if (not a and not b) or sum((a & b).values()) >= 0.8 * sum((a | b).values()) - 1e-9 and a and b:
                parent[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        least[find(i)] = min(doc, least.get(find(i), doc))
    return {doc: least[find(i)] for i, (doc, _) in enumerate(rows)}


def test_classes(spark):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(300)]
    w, rows = [rng.choice(vocabulary) for _ in range(100)], []
    for i in range(90):
        if rng.random() < 0.7:
            if rng.random() < 0.4:  # drift: chains of near copies whose ends are far apart
                w = list(w)
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            x = list(w)
            for _ in range(rng.randint(0, 3)):
                x[rng.randrange(len(x))] = rng.choice(vocabulary)
        else:
            x = [rng.choice(vocabulary[:40]) for _ in range(rng.randint(0, 12))]
        rows.append((i, " ".join(x)))
    got = {r.doc_id: r.class_id for r in near_dup.classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert got == class_of(rows)


def test_a_large_group_of_near_copies(spark):
    rng = random.Random(14)
    some = lambda n: [f"w{rng.randrange(9000)}" for _ in range(n)]
    base, passage, rows = some(120), some(25), []
    for i in range(260):
        w = list(rows[rng.randrange(len(rows))][1].split()) if rows and rng.random() < 0.3 else list(base)
        for _ in range(rng.choice((0, 1, 2, 3, 5, 8))):
            w[rng.randrange(len(w))] = rng.choice(some(1))
        kind = rng.random()
        w = w[: rng.randint(60, len(w))] if kind < 0.2 and len(w) > 60 else w + passage * rng.randint(1, 3) if kind < 0.35 else w
        rows.append((i, " ".join(w)))
    got = {r.doc_id: r.class_id for r in near_dup.classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    want = class_of(rows)
    assert len(set(want.values())) > 20 and got == want


def test_similar_texts_meet_in_their_differences():
    rng = random.Random(15)
    base, met = [f"w{i}" for i in range(90)], 0
    texts = [base]
    for _ in range(220):
        w = list(rng.choice(texts))
        for _ in range(rng.randint(1, 2)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(3000)}"
        texts.append(w[: rng.randint(50, len(w))] if rng.random() < 0.2 and len(w) > 50 else w)
    bags = near_dup.elements([" ".join(w) for w in texts])
    leader, posted = bags[0], []
    for e in bags:
        distance, added, gone = near_dup.differences(e, leader)
        keys = near_dup.posts(np.concatenate([added, gone]), len(e), len(leader), distance <= 0.2 + 1e-9)
        posted.append((distance <= 0.2 + 1e-9, {int(k) >> 2: int(k) & 3 for k in keys}))
    for i, a in enumerate(bags):
        for j in range(i):
            if near_dup.differences(a, bags[j])[0] <= 0.2 + 1e-9 and not (posted[i][0] and posted[j][0]):
                shared = [(posted[i][1][k], posted[j][1][k]) for k in posted[i][1].keys() & posted[j][1].keys()]
                assert any(x != y or x == 2 for x, y in shared)
                met += 1
    assert met > 100


def test_registers_estimate_weighted_similarity():
    rng = random.Random(7)
    found = []
    for _ in range(40):
        w = [rng.choice("abcdef") for _ in range(200)]
        x = w[:150] + [rng.choice("uvwxyz") for _ in range(50)]
        a, b = " ".join(w), " ".join(x)
        s, _ = near_dup.signatures([a, b])
        assert near_dup.overlaps([a], [b])[0] == pytest.approx(1 - sum((shingle_bag(a) & shingle_bag(b)).values()) / sum((shingle_bag(a) | shingle_bag(b)).values()))
        found.append((s[0] == s[1]).mean() - (1 - near_dup.overlaps([a], [b])[0]))
    assert abs(np.mean(found)) < 0.03


def test_band_keys_do_not_depend_on_the_batch(spark):
    rng = random.Random(9)
    word = lambda: f"w{rng.randrange(500)}"
    texts = [" ".join(word() for _ in range(rng.randint(1, 80))) for _ in range(1000)]
    alone = near_dup.band_keys(texts[:1])[0]
    for n in (2, 10, 1000):
        assert (near_dup.band_keys(texts[:n])[0] == alone).all()
    whole = near_dup.signatures(texts[:700])[0]
    for n in (1, 5, 40):
        assert (np.concatenate([near_dup.signatures(texts[i : min(i + n, 700)])[0] for i in range(0, 700, n)]) == whole).all()
    # near copies that are signed in batches of different widths
    base = [word() for _ in range(200)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(2000 + i, " ".join([*base[:-1], f"z{i}"])) for i in range(3)]
    parts = [rows[:700] + [rows[1000]], rows[700:703] + [rows[1001]], [rows[1002]]]
    df = spark.createDataFrame(spark.sparkContext.parallelize(parts, 3).flatMap(lambda x: x), "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in near_dup.classes(df).where("doc_id >= 2000").collect()}
    assert got == {2000: 2000, 2001: 2000, 2002: 2000}


def test_classes_awkward(spark):
    rows = [(5, "one two three"), (5, "one two three"), (9, "one two three"), (None, None), (3, ""), (4, " \n"), (6, "x " * 20000), (7, "x " * 20001)]
    df = spark.createDataFrame([(a, b, "extra") for a, b in rows], "doc_id long, text string, class_id string")
    got = sorted(((r.doc_id, r.class_id, r.is_kept) for r in near_dup.classes(df).collect()), key=repr)
    assert got == sorted([(5, 5, True), (5, 5, True), (9, 5, False), (None, 3, False), (3, 3, True), (4, 4, True), (6, 6, True), (7, 6, False)], key=repr)
    assert near_dup.classes(df.limit(0)).count() == 0
    assert sorted(r.doc_id for r in near_dup.keep_one(df).collect()) == [3, 4, 5, 6]


def test_unrelated_texts_of_one_id_stay_apart(spark):
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(None, "null id one"), (None, "null id two, unrelated"), (None, f"{long} null"), (7, "seven one"), (7, "seven two, unrelated"), (7, "seven one"), (8, long), (8, f"{long} end"), (9, f"{long} null")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    key = {r.text: r.class_key for r in df.join(near_dup.near_duplicates(df), F.xxhash64("text") == F.col("node")).collect()}
    assert len(set(key.values())) == 5 and key[long] == key[f"{long} end"] == key[f"{long} null"]
    got = near_dup.classes(df)
    assert got.count() == 9 and got.select("class_key").distinct().count() == 5
    kept = sorted(((r.doc_id, r.text) for r in near_dup.keep_one(df).collect()), key=repr)
    assert len(kept) == 5 and {r for r in kept if r[0] != 8} == {(None, "null id one"), (None, "null id two, unrelated"), (7, "seven one"), (7, "seven two, unrelated")}
    assert [r[1] in (long, f"{long} end") for r in kept if r[0] == 8] == [True]


def test_different_texts_of_one_hash_stay_apart(spark, monkeypatch):
    said = lambda w: " ".join(f"{w}{i}" for i in range(40))
    rows = [(1, said("a")), (2, said("b")), (3, said("a")), (4, said("b") + " bx"), (5, said("longer")), (6, ""), (7, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = {r.doc_id: r.class_id for r in near_dup.classes(df).collect()}
    assert want == {1: 1, 2: 2, 3: 1, 4: 2, 5: 5, 6: 6, 7: 6}
    monkeypatch.setattr(near_dup, "text_hash", lambda text: F.xxhash64(F.length(text)))
    assert {r.doc_id: r.class_id for r in near_dup.classes(df).collect()} == want
    assert sorted(r.doc_id for r in near_dup.keep_one(df).collect()) == [1, 2, 5, 6]


def test_pipeline_stages_keep_what_brute_force_keeps(spark):
    import corpus_pipeline

    rng = random.Random(12)
    some = lambda n: " ".join(f"w{rng.randrange(900)}" for _ in range(n))
    bases, passage = [some(70) for _ in range(5)], some(30)
    rows = [(i, f"{b} {e}") for i, (b, e) in enumerate((b, e) for b in bases for e in ("one", "two", "two"))]
    rows += [(None, some(40)), (None, some(40)), (None, f"{bases[0]} three"), (None, None), (50, ""), (60, some(40)), (60, some(40)), (60, rows[3][1]), (61, f"{some(20)} {passage}"), (62, f"{passage} {some(20)}"), (62, f"{some(9)} {passage}")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    group = class_of([(k, t) for k, (_, t) in enumerate(rows)])
    members = collections.defaultdict(list)
    for k, g in group.items():
        members[g].append(rows[k])
    once = corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()
    assert len(once) == len(members)
    for found in members.values():
        least = min((i for i, _ in found if i is not None), default=None)
        assert sum((r.doc_id, r.text) in [m for m in found if m[0] == least] for r in once) == 1
    left = corpus_pipeline.drop_repeats(spark, spark.createDataFrame(once, docs.schema).repartition(3), "").collect()
    order = sorted(once, key=lambda r: (r.doc_id is not None, r.doc_id or 0, (r.text or "").encode()))
    want = trimmed([(k, r.text or "") for k, r in enumerate(order)])
    assert sum(v[1] for v in want.values()) > 2 * 100
    assert collections.Counter((r.doc_id, hashlib.sha256(r.text.encode()).hexdigest(), r.n_chars) for r in left) == collections.Counter((order[k].doc_id, v[3], v[0] - v[1]) for k, v in want.items())
