"""Packing, spelling variants and periodic runs against the library and brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from missiva.llm import packing, periodic, queries, spelling

PATH = public_tokenizers.path("byte_bpe_50k.json")
DOCS = "doc_id long, text string, sequence_id string, n long, word string"
AWKWARD = [(1, None, "x", 1, "y"), (None, "One two. Three", "x", 1, "y"), (3, "", None, None, None), (4, "same words here. " * 9, "x", 1, "y"), (4, "same words here. " * 9, "x", 1, "y"), (5, "long" * 60_000 + " end", "x", 1, "y"), (6, "a b " * 30_000, "x", 1, "y"), (7, " " * 200_000 + "<|endoftext|>z", "x", 1, "y")]


def cheapest(at, penalty, size):
    """Cost of the best cuts by trying every predecessor."""
    best = [0]
    for i in range(1, len(at)):
        pads = [(best[j], at[i] - at[j]) for j in range(i) if at[i] - at[j] <= size]
        best.append(penalty[i] + min(b + (0 if n & (n - 1) == 0 else size - n) for b, n in pads))
    return best[-1]


def test_cuts_are_the_cheapest():
    rnd = np.random.default_rng(3)
    for _ in range(200):
        size = int(rnd.choice([8, 16, 64]))
        ends = np.cumsum(rnd.integers(1, 3 * size, rnd.integers(1, 8)))
        n = int(ends[-1])
        sentences = np.flatnonzero(rnd.random(n) < 0.2)[1:]
        at, penalty = packing.possible_cuts(n, ends, sentences, bool(rnd.random() < 0.5), size)
        assert at[0] == 0 and at[-1] == n and np.diff(at).max() <= size and set(ends) <= set(at.tolist())
        cuts = packing.best_cuts(at, penalty, size)
        lengths = np.diff(cuts)
        assert lengths.max() <= size and cuts[0] == 0 and cuts[-1] == n
        price = dict(zip(at.tolist(), penalty.tolist()))
        cost = sum((0 if x & (x - 1) == 0 else size - x) for x in lengths.tolist()) + sum(price[c] for c in cuts[1:].tolist())
        assert cost == cheapest(at.tolist(), penalty.tolist(), size)


def check_pieces(rows, documents, size=2048):
    """Every token of every document in one piece, in order; windows without gaps; the share of padding."""
    library = Tokenizer.from_file(PATH)
    want = Counter()
    for doc_id, text in documents:
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 1], dtype="<u4")
        want[doc_id, len(ids), hashlib.sha256(ids.tobytes()).hexdigest()] += 1
    windows = defaultdict(list)
    for r in rows:
        assert r["length"] > 0 and r["ids_crc32"] == zlib.crc32(r["ids"]) and len(r["ids"]) == 4 * r["length"]
        windows[r["sequence_id"]].append(r)
    padding = total = 0
    found, part, reached = Counter(), b"", 0
    for sequence in sorted(windows):
        pieces = sorted(windows[sequence], key=lambda r: r["offset"])
        at = 0
        for r in pieces:  # sequences of a partition follow each other, so a document's pieces do
            assert r["offset"] == at and r["start"] == reached
            at, part, reached = at + r["length"], part + r["ids"], reached + r["length"]
            if reached == r["doc_tokens"]:
                found[r["doc_id"], reached, hashlib.sha256(part).hexdigest()] += 1
                part, reached = b"", 0
        assert at <= size
        padding, total = padding + (0 if at & (at - 1) == 0 else size - at), total + at
    assert found == want
    return padding / total


def test_pieces_hold_the_librarys_tokens(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = packing.pack(docs, PATH).collect()
    assert check_pieces(rows, [(d.doc_id, d.text) for d in docs.select("doc_id", "text").collect()]) < 0.02
    thin = queries.op11_packing(spark, sf_dir)
    assert thin.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert sorted(tuple(r) for r in thin.collect()) == sorted(tuple(r)[:-1] for r in rows)


def test_packing_awkward(spark):
    docs = spark.createDataFrame(AWKWARD, DOCS)
    check_pieces(packing.pack(docs, PATH).collect(), [(r[0], r[1]) for r in AWKWARD])
    check_pieces(packing.pack(docs.coalesce(1), PATH, size=64).collect(), [(r[0], r[1]) for r in AWKWARD], 64)
    assert packing.pack(docs.limit(0), PATH).count() == 0


def test_stretches_join_without_a_seam(monkeypatch):
    monkeypatch.setattr(packing, "STRETCH", 3000)
    packer, out = packing.Packer(packing.Tokens(PATH), 256, 1, 0), []
    documents = [(i, "Some words of a text. " * (7 * i % 60)) for i in range(60)]
    for d in documents:
        out += [b for b in packer.add(*d)]
    out += [b for b in packer.cut(last=True)]
    assert len(out) >= 4
    check_pieces([r for b in out for r in b.to_pylist()], documents, 256)


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    long, short = (a, b) if len(a) > len(b) else (b, a)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def brute_variants(documents, least_length=5, least_count=3):
    n = Counter()
    for doc_id, text in documents:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{w}".encode())
            if h % 97 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            n[w] += 1
    n = {w: c for w, c in n.items() if len(w) >= least_length and c >= least_count}
    form, count = {}, {}
    for w in n:
        by = [x for x in n if near(w, x)]
        best = min(by, key=lambda x: (-n[x], x), default=None)
        form[w], count[w] = (best if best is not None and n[best] >= 2 * n[w] else None), len(by)
    def root(w):
        while form[w]:
            w = form[w]
        return w
    return sorted((w, form[w], root(w), n[w], count[w], n.get(form[w])) for w in n)


def variants(docs, **options):
    return sorted(tuple(r) for r in spelling.variants(docs, **options).collect())


def test_variants_equal_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id < 60")
    documents = [(d.doc_id, d.text) for d in docs.collect()]
    want = brute_variants(documents)
    assert variants(docs) == want and len(want) > 100 and any(w[1] for w in want)


def test_short_alphabets_and_long_words(spark):
    rnd = random.Random(5)
    words = ["".join(rnd.choice("abÿ") for _ in range(rnd.randint(3, 8))) for _ in range(400)]
    words += [w[:3] + "AAAA" + w[3:] for w in words[:20]] + ["x" * 3000, "x" * 2999, "x" * 1500 + "y" + "x" * 1499, "é" * 6, "é" * 7]
    documents = [(i % 7 if i % 5 else None, " ".join(rnd.choice(words) for _ in range(300))) for i in range(12)] + [(1, None), (2, "")]
    documents += [(40 + i, " ".join(words[-5:])) for i in range(4)]
    docs = spark.createDataFrame([(a, b, "x", 1, "y") for a, b in documents], DOCS)
    assert variants(docs) == brute_variants(documents)
    assert variants(docs.limit(0)) == []


def test_pairs_come_once(spark):
    words = ["aaaaa", "aaaaaa", "aaaaaaa", "abaaaaa", "aabbaa", "aabba", "abbaa", "aabaa", "bbbbb"]
    got = [(r.a, r.b) for r in spelling.near_pairs(spark.createDataFrame([(w, 3) for w in words], "word string, n long")).collect()]
    want = [tuple(sorted((a, b))) for i, a in enumerate(words) for b in words[:i] if near(a, b)]
    assert sorted(tuple(sorted(p)) for p in got) == sorted(want)


def brute_runs(w, least=24):
    out = []
    for p in range(1, len(w) // 3 + 1):
        i = 0
        while i + p < len(w):
            j = i
            while j + p < len(w) and w[j] == w[j + p]:
                j += 1
            n = j + p - i
            if j > i and n >= max(least, 3 * p) and not any(all(w[k] == w[k + d] for k in range(i, i + n - d)) for d in range(1, p)):
                out.append((i, n, p))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("letters", [1, 2, 3, 6])
def test_runs_equal_brute_force(letters):
    rnd = random.Random(letters)
    for _ in range(250):
        w = [rnd.randrange(letters) for _ in range(rnd.randint(0, 90))]
        for _ in range(rnd.randint(0, 3)):
            if len(w) > 4:
                a, p = rnd.randrange(len(w)), rnd.randint(1, 9)
                for i in range(a + p, min(len(w), a + rnd.randint(1, 60))):
                    w[i] = w[i - p]
        for least in (24, 6):
            assert periodic.runs_of(w, least) == brute_runs(w, least)
            texts = [[b"x"], [b"%d" % x for x in w], [b"%d" % x for x in w[::-1]]]
            assert periodic.find_runs(texts, least) == [[], brute_runs(w, least), brute_runs(w[::-1], least)]


def brute_row(doc_id, text):
    w = re.findall("[^\x20\x09-\x0d]+", text or "")
    n = len(w)
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(w)
    top = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=(None, None, None))
    dropped = {i for s, m, p in runs for i in range(s + p, s + m)}
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(runs), *top, 1000 * top[1] // top[2] if runs else None, digest("".join(f"{s},{m},{p}\n" for s, m, p in runs)), digest(" ".join(x for i, x in enumerate(w) if i not in dropped)))


def test_periodic_rows(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("length(text) < 6000")
    want = [brute_row(d.doc_id, d.text) for d in docs.select("doc_id", "text").collect()]
    got = [tuple(r) for r in periodic.periodic_runs(docs, plant=True, keep=()).collect()]
    assert sorted(got) == sorted(want) and sum(r[1] for r in want) > 5
    assert queries.op13_periodic_runs(spark, sf_dir).columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def test_periodic_awkward(spark):
    docs = spark.createDataFrame(AWKWARD, DOCS)
    rows = periodic.periodic_runs(docs).collect()
    assert len(rows) == len(AWKWARD)
    one = next(r for r in rows if r.doc_id == 1)
    assert tuple(one) == (1, 0, None, None, None, None, *[hashlib.sha256(b"").hexdigest()] * 2, [], "")
    fours = [tuple(r)[:8] for r in rows if r.doc_id == 4]
    assert [f[1:6] for f in fours] == [(1, 0, 27, 3, 9000)] * 2
    six = next(r for r in rows if r.doc_id == 6)
    assert (six.n_runs, six.start, six.length, six.period, six.exponent_milli, six.collapsed) == (1, 0, 60_000, 2, 30_000_000, "a b")
    assert [tuple(x) for x in six.runs] == [(0, 60_000, 2)]
    assert periodic.periodic_runs(docs.limit(0)).count() == 0
