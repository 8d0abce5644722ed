"""Repetition rules, quality classifier and toxicity network."""

import random
import zlib

import numpy as np
import pytest
from duck import connect, rows

from missiva.llm import quality, queries, repetition, toxicity

DOCS = "doc_id long, text string, score double, labels string"


def awkward(spark):
    return spark.createDataFrame([(1, "a b", 1.0, "x"), (1, "a b", 1.0, "x"), (None, None, None, None), (3, "", 2.0, "y"), (4, "word " * 30000, 0.0, None), (5, "\n \t", 0.0, None)], DOCS)


def test_longest_repeats():
    rng = random.Random(3)

    def brute(w):
        out = []
        for i in range(len(w)):
            best = 0
            for j in range(len(w)):
                k = 0
                while i != j and max(i, j) + k < len(w) and w[i + k] == w[j + k]:
                    k += 1
                best = max(best, k)
            out.append(best)
        return out

    for _ in range(150):
        texts = [[rng.randint(0, rng.choice([1, 3, 9])) for _ in range(rng.randint(0, 30))] for _ in range(rng.randint(1, 5))]
        got = repetition.longest_repeats(np.array(sum(texts, []), dtype=np.int64), np.array([len(t) for t in texts])).tolist()
        assert got == sum(map(brute, texts), [])


def test_rules(spark, sf_dir):
    got = queries.QUERIES["op3_quality_rules"](spark, sf_dir).toPandas()
    assert rows(got) == rows(connect(sf_dir).sql(queries.SQL["op3_quality_rules"]).df())
    out = {r.doc_id: r for r in repetition.repetition_rules(awkward(spark)).collect()}
    assert (out[4].n_words, out[4].n_repeat_words, out[4].longest_repeat, out[4].base_failed, out[4].kept) == (30000, 30000, 29999, True, False)
    assert out[None].n_words == out[3].n_words == out[5].n_words == 0 and out[None].base_failed
    assert len(repetition.repetition_rules(awkward(spark)).collect()) == 6 and repetition.repetition_rules(awkward(spark).limit(0)).count() == 0


def test_isotonic():
    got = quality.pool_adjacent(np.array([0.0, 3.0, 1.0, 4.0]), np.array([2.0, 3.0, 2.0, 4.0]))
    assert got.tolist() == pytest.approx([0, 0.8, 0.8, 1])


def test_quality_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.QUERIES["op1_quality_classifier"](spark, sf).toPandas()
    truth = spark.read.parquet(f"{sf}/labels.parquet").toPandas()
    assert got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.3)).all()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id]).all()
    seen = got[got.held_out].merge(truth, on="doc_id")
    assert (seen.predicted == seen.quality).mean() > 0.9


def test_quality_awkward(spark):
    labels = spark.createDataFrame([(1, 1, 0), (2, None, 1), (None, 0, 0)], "doc_id long, quality int, toxic int")
    assert quality.score_quality(awkward(spark), labels).count() == 6
    none = quality.score_quality(awkward(spark), labels.limit(0)).collect()
    assert {r.score for r in none} == {0.5} and [r.held_out for r in none if r.doc_id is None] == [True]
    assert quality.score_quality(awkward(spark).limit(0), labels).count() == 0


def test_network_gradients():
    old, toxicity.WINDOW = toxicity.WINDOW, 6
    try:
        net, rng = toxicity.Network(), np.random.default_rng(0)
        for k in net.p:
            net.p[k] = net.p[k].astype(np.float64)
        gates, w = [rng.normal(size=(9, toxicity.HIDDEN)) for _ in range(6)], rng.integers(0, 9, size=(5, 6))
        w[:, 0] = 1
        d = rng.normal(size=5)
        grad, tables = net.backward(gates, net.forward(gates, w, keep=True), d)
        spots = [(net.p[k], grad[k], (1,) * net.p[k].ndim) for k in ("o", "v", "ab", "a", "h0", "h1")] + [(gates[3 * k + 2], tables[k][:, 16:], (3, 5)) for k in (0, 1)]
        for value, slope, at in spots:
            kept = value[at]
            value[at] = kept + 1e-2
            high = (net.forward(gates, w) * d).sum()
            value[at] = kept - 1e-2
            low = (net.forward(gates, w) * d).sum()
            value[at] = kept
            assert (high - low) / 2e-2 == pytest.approx(slope[at], rel=0.05, abs=2e-5)
    finally:
        toxicity.WINDOW = old


def test_windows_cover_every_word():
    ids = [list(range(1, n + 1)) for n in (0, 1, 39, 40, 41, 70, 71, 200)]
    w, per = toxicity.windows(ids)
    at = np.cumsum(per) - per
    for i, (a, n) in enumerate(zip(at, per)):
        assert set(w[a : a + n].ravel()) - {0} == set(ids[i])


def test_spans_of_half_a_window_lie_whole_in_one():
    w, _ = toxicity.windows([list(range(1, 201))])
    assert all(any({*range(i, i + 20)} <= {*x} for x in w.tolist()) for i in range(1, 182))


def test_long_runs_are_scored_whole():
    rng = random.Random(5)
    run = "".join(rng.choice("abcdefgh") for _ in range(1000))
    for n in (1, 63, 64, 65, 112, 113, 160, 161, 1000):
        pieces = toxicity.words_of(run[:n])
        assert max(map(len, pieces)) <= toxicity.PIECE and len(pieces) == (1 if n <= 64 else 1 + -(-(n - 64) // 48))
        assert all(any(run[:n][i : i + 17] in p for p in pieces) for i in range(max(1, n - 16)))
    assert toxicity.words_of(f"A {run[:100]}\nb") == ["a", run[:64], run[48:100], "b"]
    scorer = toxicity.Scorer(toxicity.Network())
    scorer.net.prior = 0.1
    plain, late = scorer([run, run[:900] + "vileness" + run[908:]])
    assert plain != late


def test_toxic_words_are_learned(spark):
    rng = random.Random(2)
    plain = [f"w{i}" for i in range(60)]

    def text(bad):
        words = [rng.choice(plain) for _ in range(rng.randint(20, 120))]
        if bad:
            words[rng.randrange(len(words))] = rng.choice(["vileness", "vilest", "viler"])
        return " ".join(words)

    data = [(i, text(i % 4 == 0), i % 4 == 0) for i in range(400)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in data] + [(None, None), (1000, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(b)) for i, _, b in data], "doc_id long, toxic int")
    got = toxicity.score_toxicity(docs, labels).collect()
    bad = {i for i, _, b in data if b}
    unseen = [r for r in got if r.held_out and r.doc_id in range(400)]
    assert len(got) == 402 and sum((r.predicted == 1) == (r.doc_id in bad) for r in unseen) / len(unseen) > 0.9
    assert all(r.predicted == 0 for r in got if r.doc_id in (None, 1000))
    assert {r.score for r in toxicity.score_toxicity(docs, labels.limit(0)).collect()} == {0.0}


def test_windows_are_scored_as_a_plain_loop_scores_them():
    net, rng = toxicity.Network(), random.Random(3)
    net.prior, h = 0.3, toxicity.HIDDEN
    for k in ("o", "a", "v"):
        net.p[k] = net.p[k] * 3

    def vector(word):
        number, grams, size = toxicity.word_features([word])
        return np.concatenate([net.p["word"][number[0]], net.p["gram"][grams].sum(axis=0) / np.sqrt(size[0])])

    def soft(x):
        return x / (1 + np.abs(x))

    def states(vectors, k):
        s, out = np.zeros(h), []
        for x in vectors:
            g, u = x @ net.p[f"x{k}"] + net.p[f"b{k}"], s @ net.p[f"h{k}"]
            r, z = (soft(g[:h] + u[:h]) + 1) / 2, (soft(g[h : 2 * h] + u[h : 2 * h]) + 1) / 2
            s = z * s + (1 - z) * soft(g[2 * h :] + r * u[2 * h :])
            out.append(s)
        return out

    def plain(text):
        words, best = toxicity.words_of(text), None
        if not words:
            return net.prior
        for at in range(0, max(1, len(words) - toxicity.WINDOW + toxicity.STRIDE), toxicity.STRIDE):
            window = words[at : at + toxicity.WINDOW]
            vectors = [vector(w) for w in window] + [vector("")] * (toxicity.WINDOW - len(window))
            both = [np.concatenate(p) for p in zip(states(vectors, 0), states(vectors[::-1], 1)[::-1])][: len(window)]
            weight = np.exp([soft(s @ net.p["a"] + net.p["ab"]) @ net.p["v"] for s in both])
            logit = sum(w * s for w, s in zip(weight / weight.sum(), both)) @ net.p["o"] + net.p["ob"][0]
            best = logit if best is None else max(best, logit)
        return 1 / (1 + np.exp(-best))

    texts = [" ".join(rng.choice(["Aa", "bb,", "ccc", "déjà", "x" * 90]) + str(rng.randrange(30)) for _ in range(n)) for n in (0, 1, 39, 40, 41, 60, 61, 130)]
    assert toxicity.Scorer(net)(texts) == pytest.approx([plain(t) for t in texts], abs=1e-4)


def test_toxicity_awkward(spark):
    docs = awkward(spark).withColumnRenamed("labels", "predicted").unionByName(spark.createDataFrame([(k, f"plain{k} vile{k % 2}", 0.0, "z") for k in range(6, 40)], DOCS.replace("labels", "predicted")))
    labels = spark.createDataFrame([(k, k % 2) for k in range(6, 40)] + [(1, None)], "doc_id long, toxic int")
    got = toxicity.score_toxicity(docs, labels, keep=("text", "score")).collect()
    assert len(got) == 40 and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id == 1}) == 1 and sum(r.doc_id == 1 for r in got) == 2
    assert {r.keep_text for r in got if r.doc_id in (None, 3)} == {None, ""} and {r.keep_score for r in got if r.doc_id == 3} == {2.0}
    assert toxicity.score_toxicity(docs.limit(0), labels, keep=("text",)).count() == 0


def test_quality_scores_as_plain_numpy_has_them(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(["alpha", "beta.", "GAMMA", "1234", "x", "#"]) for _ in range(rng.randint(0, 60)))) for i in range(500)]
    rows += rows[:5] + [(None, "no id at all"), (700, None)]
    label = {i: int(len(t or "") % 3 == 0) for i, t in rows if i is not None and i % 4}
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = quality.score_quality(docs, spark.createDataFrame(list(label.items()), "doc_id long, quality int"))
    stats = quality.text_statistics(docs).toPandas()
    x = stats[list(quality.NAMES)].to_numpy()
    basis = quality.Basis(x.mean(axis=0), x.std(axis=0))
    out = lambda i: i is None or i != i or zlib.crc32(str(int(i)).encode()) % 5 == 0
    held = np.array([out(i) for i in stats.doc_id])
    y = np.array([label.get(-1 if i != i else int(i), -1) for i in stats.doc_id])
    known = ~held & (y >= 0)
    z, fold = basis(x[known]), np.array([zlib.crc32(str(int(i)).encode()) // 5 % quality.FOLDS for i in stats.doc_id[known]])

    def ridge(a, b):
        return np.linalg.inv(a.T @ a + quality.PENALTY * len(a) * np.eye(a.shape[1])) @ a.T @ b

    raw = np.zeros(len(z))
    for k in range(quality.FOLDS):
        raw[fold == k] = z[fold == k] @ ridge(z[fold != k], y[known][fold != k])
    at = np.clip((raw - quality.LOW) / (quality.HIGH - quality.LOW) * quality.BINS, 0, quality.BINS - 1).astype(int)
    bins = np.unique(at)
    n, s = np.array([(at == b).sum() for b in bins]), np.array([y[known][at == b].sum() for b in bins])
    mean = lambda j, k: s[j : k + 1].sum() / n[j : k + 1].sum()
    fitted = [max(min(mean(j, k) for k in range(i, len(bins))) for j in range(i + 1)) for i in range(len(bins))]
    centres = quality.LOW + (bins + 0.5) / quality.BINS * (quality.HIGH - quality.LOW)
    want = np.clip(np.interp(basis(x) @ ridge(z, y[known]), centres, fitted), 0, 1)
    key = lambda i: -1 if i is None or i != i else int(i)
    mine = sorted(((key(i), bool(h), p) for i, h, p in zip(stats.doc_id, held, want)))
    theirs = sorted((key(r.doc_id), r.held_out, r.score) for r in got.collect())
    assert [r[:2] for r in mine] == [r[:2] for r in theirs]
    assert [r[2] for r in theirs] == pytest.approx([r[2] for r in mine], abs=1e-6)


def test_random_features_approximate_the_kernel():
    rng = np.random.default_rng(1)
    d = len(quality.NAMES)
    x = rng.normal(size=(60, d))
    z = quality.Basis(np.zeros(d), np.ones(d))(x)[:, :-1]
    kernel = np.exp(-((x[:, None] - x[None]) ** 2).sum(axis=2) / (2 * d))
    assert np.abs(z @ z.T - kernel).mean() < 0.1
