"""Running totals and packing over blocks against sequential rules."""

import random

import pytest

from missiva.operators import archive, ranges


def packed(lengths, most):
    """Chunk numbers by the plain rule: a chunk takes messages while they fit; what does not fit starts the next."""
    out, chunk, used, empty = [], 1, 0, True
    for n in lengths:
        n = max(0, n or 0)
        if not empty and used + n > most:
            chunk, used = chunk + 1, 0
        empty, used = False, used + n
        out.append(chunk)
    return out


def expected(rows, most):
    groups = {}
    for key, no, n in sorted(rows, key=lambda r: (r[1], max(0, r[2] or 0))):
        groups.setdefault(key, []).append((no, n))
    return {(k, no): c for k, g in groups.items() for (no, _), c in zip(g, packed([n for _, n in g], most), strict=True)}


@pytest.mark.parametrize("seed", range(4))
def test_pack_equals_the_sequential_rule(spark, seed, monkeypatch):
    monkeypatch.setattr(ranges, "FAN", 3)
    rng = random.Random(seed)
    sizes = [0, 0, 1, 2, 3, 7, 20, 50, 51, 200, None, -4] if seed % 2 else [1, 2, 3]
    rows = [("hot", i, rng.choice(sizes)) for i in range(1500)]
    rows += [(rng.choice(["a", "b", "c", None]), 10_000 + i, rng.choice(sizes)) for i in range(300)]
    rows += [(f"k{i}", i, rng.choice(sizes)) for i in range(200)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "key string, no long, n long")
    for blocks in (1, 5, 29):
        got = ranges.pack(df, ["key"], ["no"], "n", 50, blocks).collect()
        assert len(got) == len(rows)
        assert {(r.key, r.no): r.chunk for r in got} == expected(rows, 50)


def test_one_chunk_may_pass_whole_blocks(spark, monkeypatch):
    monkeypatch.setattr(ranges, "FAN", 2)
    rows = [("hot", i, 1) for i in range(900)]
    got = ranges.pack(spark.createDataFrame(rows, "key string, no long, n long"), ["key"], ["no"], "n", 400, 20)
    assert {(r.key, r.no): r.chunk for r in got.collect()} == expected(rows, 400)


def test_a_large_thread_is_packed_over_several_tasks(spark):
    df = spark.range(200_000).selectExpr("cast(null as string) as key", "id as no", "pmod(hash(id), 900) as n")
    got = ranges.pack(df, ["key"], ["no"], "n", 5_000, 16).orderBy("no").toPandas()
    assert got.chunk.tolist() == packed(got.n.tolist(), 5_000)
    blocks = ranges.blocks_of(df, ["key"], ["no"], "n", 16)
    assert blocks.select("__block").distinct().count() > 8


def test_pack_of_nothing(spark):
    none = spark.createDataFrame([], "key string, no long, n long")
    assert ranges.pack(none, ["key"], ["no"], "n", 10).collect() == []
    assert ranges.running_totals(none, ["key"], ["no"], "n").collect() == []


def test_running_totals_and_admission(spark):
    rng = random.Random(5)
    rows = [("hot" if i % 3 else None, i, rng.choice([0, 1, 5, None, 40])) for i in range(700)] + [("one", 1, 99)]
    df = spark.createDataFrame(rows, "key string, no long, n long")
    totals, want = {}, {}
    for key, no, n in rows:
        run, rn = totals.get(key, (0, 0))
        totals[key] = want[key, no] = (run + (n or 0), rn + 1)
    got = {(r.key, r.no): (r.running, r.rn) for r in ranges.running_totals(df, ["key"], ["no"], "n", 11).collect()}
    assert got == want
    taken = {(r.key, r.no) for r in archive.admit(df, ["key"], ["no"], "n", 60).collect()}
    assert taken == {k for k, (run, rn) in want.items() if run <= 60 or rn == 1}
