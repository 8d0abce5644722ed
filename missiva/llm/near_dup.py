"""Near-duplicate classes by BagMinHash signatures of word-shingle multisets.

A document is a multiset of 5-word shingles. Each shingle owns independent Poisson processes over
the weight axis, one per dyadic block of weights (0,1], (1,2], (2,4], ...: a point has a time, a
register and a weight level, and counts for a document if its level is at most the shingle's number
of occurrences there. Each register keeps its earliest point, so two documents agree in a register
with probability equal to their weighted Jaccard similarity. Points are made in order of time and
only up to the time by which all registers are filled, so the work per document is its length plus
a constant, not length times registers.

Exact copies are one node. Registers are banded, and the members of a bucket are compared with its
leader only, the member whose bands have the most company (the text that others were copied from, if
there is one), by exact multiset overlap. Links make classes, their connected components. A bucket
whose other members are in several classes goes on: relative to a centre, a text is the set of
shingles by which it differs, and two texts that are similar, but not both to the centre, share part
of these differences. So each member posts just enough of its differences, the rarest first (prefix
filtering, made exact by the triangle of the three texts), under keys that are new, small buckets.
Their members are compared in rounds with one leader, then four, and so on, across classes only. No
bucket of near copies is expanded into its pairs, and no link that would join two classes is lost.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from missiva.operators.components import connected_components
from missiva.session import lean, materialize, sized, small_batches

SHINGLE, SIMILAR = 5, 0.8
#: Two documents of similarity 0.8 share no band with probability (1 - 0.8^6)^40 = 5e-6; of similarity 0.3, they share one with 0.03.
BANDS, ROWS = 40, 6
REGISTERS = BANDS * ROWS
BATCH_BYTES = 500_000
#: The text of a leader is copied once for each so much company.
COMPANY = 20_000
#: The order of differences puts so many of the most common ones of a centre last. An order of any kind gives the same links.
COMMON = 1024
#: Least sizes of the classes of difference sets.
CLASSES = [1]
while CLASSES[-1] < 1 << 33:
    CLASSES.append(max(CLASSES[-1] + 1, CLASSES[-1] * 5 // 4))
ODD = [np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xBF58476D1CE4E5B9)]


def cuts(column: pa.Array, limit: int) -> Iterator[slice]:
    """Runs of rows of about ``limit`` bytes of a text column together (a longer text stands alone)."""
    size = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    begin = 0
    while begin < len(size):
        before = size[begin - 1] if begin else 0
        stop = max(begin + 1, int(np.searchsorted(size, before + limit, side="right")))
        yield slice(begin, stop)
        begin = stop


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x *= ODD[3]
    x ^= x >> np.uint64(29)
    x *= ODD[4]
    x ^= x >> np.uint64(32)
    return x


def _times(n: int, odd: np.uint64) -> np.uint64:
    return np.uint64(n * int(odd) & 0xFFFFFFFFFFFFFFFF)


def shingles(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of texts: text number, 64-bit hash, occurrences. A shingle's hash does not depend on the other texts.

    Words are runs of characters other than ASCII white space. A text of one to four words has one
    shingle, all its words; a text without words has none.
    """
    every = [t.encode("utf-8").split() for t in texts]
    lengths = np.fromiter(map(len, every), dtype=np.int64, count=len(every))
    known = {w: xxhash.xxh64_intdigest(w) for w in set().union(*every)} if every else {}
    words = np.fromiter((known[w] for ws in every for w in ws), dtype=np.uint64, count=int(lengths.sum()))
    words = np.concatenate([words, np.zeros(SHINGLE, dtype=np.uint64)])
    ends = np.cumsum(lengths)
    count = np.where(lengths == 0, 0, np.maximum(1, lengths - SHINGLE + 1))
    text = np.repeat(np.arange(len(texts)), count)
    begin = np.repeat(ends - lengths, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    size = np.minimum(SHINGLE, lengths)[text]
    h = np.zeros(len(begin), dtype=np.uint64)
    for j in range(SHINGLE):
        h = _mix(h + np.where(j < size, words[begin + j] * ODD[j % 3] + np.uint64(j + 1), np.uint64(0)))
    last = np.cumsum(count)
    for a, b in zip(last - count, last):
        h[a:b].sort()
    fresh = np.ones(len(h), dtype=bool)
    fresh[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    at = np.flatnonzero(fresh)
    return text[at], h[at], np.diff(np.append(at, len(h)))


def signatures(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """One row of registers per text, and whether the text has any shingle."""
    text, h, weight = shingles(texts)
    n = len(texts)
    total = np.bincount(text, weights=weight, minlength=n)
    times = np.full(n * REGISTERS, np.inf)
    points = np.zeros(n * REGISTERS, dtype=np.uint64)
    # processes: one per shingle and dyadic block that its weight reaches
    owner, seed, low, high, most = [text], [h], [np.zeros(len(h))], [np.ones(len(h))], [weight]
    block, reach = 1, np.flatnonzero(weight > 1)
    while len(reach):
        owner.append(text[reach]), seed.append(_mix(h[reach] + _times(block, ODD[0]))), most.append(weight[reach])
        low.append(np.full(len(reach), float(1 << (block - 1)))), high.append(np.full(len(reach), float(1 << block)))
        reach = reach[weight[reach] > 1 << block]
        block += 1
    owner, seed, low, high, most = map(np.concatenate, (owner, seed, low, high, most))
    limit = REGISTERS * (np.log(REGISTERS) + 4) / np.maximum(total, 1)
    todo = np.arange(len(owner))
    while len(todo):
        live, t, k = todo, np.zeros(len(todo)), 0
        while len(live):
            x = _mix(seed[live] + _times(2 * k + 1, ODD[1]))
            t = t - np.log(((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / (high[live] - low[live])
            going = np.flatnonzero(t <= limit[owner[live]])
            live, t = live[going], t[going]
            y = _mix(x[going] + ODD[2])
            register = ((y >> np.uint64(32)) * np.uint64(REGISTERS) >> np.uint64(32)).astype(np.int64)
            level = low[live] + 1 + np.floor((y & np.uint64(0xFFFFFFFF)).astype(np.float64) * 2.0**-32 * (high[live] - low[live]))
            counts = np.flatnonzero(level <= most[live])
            at = owner[live[counts]] * REGISTERS + register[counts]
            earliest = t[counts]
            np.minimum.at(times, at, earliest)
            won = times[at] == earliest
            points[at[won]] = y[counts[won]]
            k += 1
        empty = np.isinf(times).reshape(n, REGISTERS).any(axis=1) & (total > 0)
        limit[empty] *= 2
        todo = np.flatnonzero(empty[owner])
    return points.reshape(n, REGISTERS), total > 0


def band_keys(texts: list[str]) -> list[np.ndarray | None]:
    """Keys of the bands of each text; none for a text without words."""
    points, some = signatures(texts)
    keys = np.zeros((len(texts), BANDS), dtype=np.uint64)
    for r in range(ROWS):
        keys = _mix(keys * ODD[2] + points[:, r::ROWS])
    keys = _mix(keys + np.arange(1, BANDS + 1, dtype=np.uint64) * ODD[0]).view(np.int64)
    return [keys[i] if some[i] else None for i in range(len(texts))]


def elements(texts: list[str]) -> list[np.ndarray]:
    """Each text's multiset of shingles as a sorted set: the second occurrence of a shingle is an element of its own, and so on."""
    text, h, weight = shingles(texts)
    again = np.arange(weight.sum(), dtype=np.uint64) - np.repeat(np.cumsum(weight) - weight, weight).astype(np.uint64)
    owner, h = np.repeat(text, weight), np.repeat(h, weight)
    e = np.where(again == 0, h, _mix(h + again * ODD[0]))
    ends = np.searchsorted(owner, np.arange(len(texts) + 1))
    return [np.sort(e[a:b]) for a, b in zip(ends, ends[1:])]


def differences(mine: np.ndarray, leader: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Weighted Jaccard distance of a text from a leader, and the elements that only either has."""
    at = np.searchsorted(leader, mine)
    at[at == len(leader)] = 0
    both = leader[at] == mine if len(leader) else np.zeros(len(mine), dtype=bool)
    left = np.ones(len(leader), dtype=bool)
    left[at[both]] = False
    added, gone = mine[~both], leader[left]
    shared = int(both.sum())
    return 1 - shared / max(1, shared + len(added) + len(gone)), added, gone


def posts(apart: np.ndarray, size: int, of_leader: int, linked: bool, similar: float = SIMILAR) -> np.ndarray:
    """Keys under which a text of ``size`` elements posts its differences ``apart`` from a leader of ``of_leader`` elements.

    With D the differences, a third text Y with differences E from the leader L is similar to X only if
    |D ^ E| <= h, h = (1 - s) / (1 + s) * (|X| + |Y|), so that 2 |D & E| >= |D| + |E| - h, where
    |Y| <= |X| / s and |Y| <= |L| + |E|. X and Y are to meet only if one of them is not similar to L, say
    Y: |E| > (1 - s) / (1 + s) * (|Y| + |L|), and at least one element is shared. Two sets in one order
    that share t elements share one within the first |D| - t + 1 of each. As t depends on |E|, X posts
    once for every class of sizes that |E| may be in. The last two bits of a key say which of the two
    sizes is the poster's: 0 the smaller class, 1 the larger, 2 if they are equal.
    """
    d = len(apart)
    if not d:
        return np.zeros(0, dtype=np.uint64)
    part, own = (1 - similar) / (1 + similar), bisect_right(CLASSES, d) - 1
    least = part * (similar * size + of_leader) if linked else 0
    most = (1 - similar) / similar * size + 1e-6
    keys = []
    for g in range(bisect_right(CLASSES, max(1, int(d - most))) - 1, bisect_right(CLASSES, int(d + most))):
        low, high = CLASSES[g], CLASSES[g + 1] - 1
        h = part * (size + min(size / similar, of_leader + high)) + 1e-6
        t = max(1, int(np.ceil((d + low - h) / 2)))
        if high >= least - 1e-6 and t <= min(d, high):
            key = _mix(apart[: d - t + 1] + _times(min(own, g) * 256 + max(own, g) + 1, ODD[2]))
            keys.append((key & ~np.uint64(3)) | np.uint64(2 if g == own else own > g))
    return np.concatenate(keys) if keys else np.zeros(0, dtype=np.uint64)


def overlaps(left: list[str], right: list[str]) -> np.ndarray:
    """Weighted Jaccard distances of pairs of texts."""
    return np.array([differences(a, b)[0] for a, b in zip(elements(left), elements(right))])


def _merge(parts: DataFrame | None, joined: DataFrame, rows: int) -> DataFrame:
    """Components after further links: components of the links between the old ones, and the old members under their new names."""
    if parts is None:
        return connected_components(joined)
    named = lambda df, c: df.join(parts.select(F.col("node").alias(c), F.col("component").alias("__to")), c, "left").withColumn(c, F.coalesce("__to", c)).drop("__to")
    above = connected_components(named(named(joined, "src"), "dst").select("src", "dst"))
    moved = parts.join(above.select(F.col("node").alias("component"), F.col("component").alias("__to")), "component", "left").select("node", F.coalesce("__to", "component").alias("component"))
    fresh = above.join(parts.select("node"), "node", "left_anti").select("node", "component")
    return materialize(sized(moved.unionByName(fresh), 4 * rows), "parts")


def text_hash(text: Column) -> Column:
    return F.xxhash64(text)


def with_nodes(rows: DataFrame, text: Column, clashing: DataFrame | None, node: str = "node") -> DataFrame:
    """``rows`` with the node of their text: its hash, but for the few hashes in ``clashing`` (that different texts have) a second one."""
    if clashing is None:
        return rows.withColumn(node, text_hash(text))
    rows = rows.withColumn(node, text_hash(text)).join(clashing.select(F.col("node").alias(node), F.lit(True).alias("__clash")), node, "left")
    return rows.withColumn(node, F.when(F.col("__clash"), F.xxhash64(F.lit(1), text)).otherwise(F.col(node))).drop("__clash")


def near_texts(docs: DataFrame, similar: float = SIMILAR, clashing: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:
    """``node, class_id, class_key``: the class of each different text, the key being the least node of the class; and the ``clashing`` hashes for :func:`with_nodes`. See :func:`classes`.

    A second hash tells whether a node holds different texts (of 10^10 texts two or three pairs may); if so, the work is done anew with these apart.
    """
    far = 1 - similar + 1e-9
    small_batches(docs.sparkSession, "2m")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = with_nodes(rows, F.col("text"), clashing).withColumn("other", F.xxhash64(F.lit(2), "text"))

    def sign(batches):
        for batch in batches:
            for s in cuts(batch.column(2), BATCH_BYTES):
                part = batch.slice(s.start, s.stop - s.start)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(3), pa.array(band_keys(part.column(2).to_pylist()), pa.list_(pa.int64()))], names=["node", "doc_id", "other", "bands"])

    signed = rows.select("node", "doc_id", "text", "other").mapInArrow(lean(sign), "node long, doc_id long, other long, bands array<long>")
    nodes = materialize(signed.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("bands").alias("bands"), (F.min("other") < F.max("other")).alias("several")), "nodes")
    if clashing is None and not (several := nodes.where("several").select("node")).isEmpty():
        return near_texts(docs, similar, several)
    nodes = nodes.drop("several")
    posted = nodes.select(F.explode("bands").alias("key"), "node")
    shared = posted.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    active = materialize(posted.join(shared, "key"), "active")
    # texts of the nodes that share a band with others, one each
    wanted = active.select("node").distinct().join(nodes.select("node", "doc_id"), "node")
    texts = materialize(rows.join(wanted.select(F.col("node").alias("n_"), F.col("doc_id").alias("d_")), (F.col("node") == F.col("n_")) & F.col("doc_id").eqNullSafe(F.col("d_"))).select("node", "text").dropDuplicates(["node"]), "texts")

    def compare(batches):
        names, led, known = ["node", "leader", "linked", "size", "of_leader", "added", "gone"], None, None
        for batch in batches:
            keys, more, others = batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(4)
            for s in cuts(batch.column(3), BATCH_BYTES):
                part, rows = batch.slice(s.start, s.stop - s.start), []
                for i, mine in zip(range(s.start, s.stop), elements(part.column(3).to_pylist())):
                    if led != keys[i]:
                        led, known = keys[i], elements([others[i].as_py()])[0]
                    distance, added, gone = differences(mine, known)
                    rows.append((distance <= far, len(mine), len(known), *((added.view(np.int64), gone.view(np.int64)) if more[i] else (None, None))))
                kinds = [pa.bool_(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *(pa.array(list(c), k) for c, k in zip(zip(*rows), kinds))], names=names)

    def post(batches):
        for batch in batches:
            rows, keys = batch.to_pydict(), []
            for linked, size, of_leader, added, gone, hot in zip(*(rows[c] for c in ("linked", "size", "of_leader", "added", "gone", "hot"))):
                apart = np.array(added + gone, dtype=np.int64)
                if hot:  # the most common elements last, all others in the order of differences()
                    hot = np.array(hot, dtype=np.int64)
                    by = np.argsort(hot)
                    at = np.minimum(np.searchsorted(hot[by], apart), len(hot) - 1)
                    apart = apart[np.argsort(np.where(hot[by][at] == apart, by[at] + 1, 0), kind="stable")]
                keys.append(posts(apart.view(np.uint64), size, of_leader, linked, similar).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("leader"), batch.column("part"), pa.array(keys, pa.list_(pa.int64()))], names=["node", "leader", "part", "posts"])

    def compared(asked: DataFrame, count: int) -> DataFrame:
        """Of pairs ``node, leader, more, company``: are they linked, and with ``more`` also their differences."""
        # a leader has at least a BANDS-th of its company as members: copies of its text, so that no task gets all of them, are few against those
        salts = (F.col("company") / COMPANY).cast("long")
        led = asked.groupBy(F.col("leader").alias("node")).agg(F.max("company").alias("company")).join(texts, "node").select(F.col("node").alias("leader"), F.explode(F.sequence(F.lit(0).cast("long"), salts)).alias("salt"), F.col("text").alias("b"))
        both = asked.join(texts.withColumnRenamed("text", "a"), "node").withColumn("salt", F.pmod(F.xxhash64("node"), salts + 1)).join(led, ["leader", "salt"])
        made = "node long, leader long, linked boolean, size long, of_leader long, added array<long>, gone array<long>"
        return materialize(sized(both.select("node", "leader", "more", "a", "b").mapInArrow(lean(compare), made), count, 4_000), "compared")

    def grouped(rows: DataFrame, parts: DataFrame | None) -> DataFrame:
        """``node`` and further columns, with the class of each node."""
        return rows.withColumn("part", F.col("node")) if parts is None else rows.join(parts, "node", "left").withColumn("part", F.coalesce("component", "node")).drop("component")

    ends = [F.min("part").alias("low"), F.max("part").alias("high")]
    count = active.count()
    company = active.groupBy("node").agg(F.sum("n").alias("company"))
    leaders = active.join(company, "node").groupBy("key").agg(F.max(F.struct("company", "node")).alias("l")).select("key", F.col("l.node").alias("leader"), F.col("l.company").alias("company"))
    members = materialize(sized(active.join(leaders, "key"), count), "members")
    # the centre of a bucket, of which it need not be a member: the leader of most company that any member has
    hubs = members.groupBy("node").agg(F.max(F.struct("company", "leader")).alias("hub"))
    centres = members.where("n > 2").join(hubs, "node").groupBy("key").agg(F.max("hub").alias("hub")).select("key", F.col("hub.leader").alias("centre"), F.col("hub.company").alias("company"))
    rest = materialize(sized(members.where("n > 2 and node <> leader").select("key", "node").join(centres, "key"), count), "rest")
    asked = members.where("node <> leader").select("node", "leader", F.lit(False).alias("more"), "company").unionAll(rest.where("node <> centre").select("node", "centre", F.lit(True), "company"))
    done = compared(asked.groupBy("node", "leader").agg(F.max("more").alias("more"), F.max("company").alias("company")), count)
    links = done.where("linked").select(F.col("node").alias("src"), F.col("leader").alias("dst"))
    parts = None if links.isEmpty() else _merge(None, links, count)
    # buckets whose other members are all connected are finished
    rest = materialize(sized(grouped(rest, parts).withColumnRenamed("centre", "leader"), count), "rest")
    mixed = rest.groupBy("key").agg(*ends).where("low < high").select("key")
    apart = materialize(rest.join(mixed, "key").select("node", "leader", "part").distinct().join(done, ["node", "leader"]), "apart")
    common = apart.select("leader", F.explode(F.concat("added", "gone")).alias("e")).groupBy("leader", "e").agg(F.count("*").alias("c")).where("c > 3")
    first = Window.partitionBy("leader").orderBy(F.desc("c"), "e")
    common = common.withColumn("at", F.row_number().over(first)).where(F.col("at") <= COMMON).groupBy("leader").agg(F.transform(F.array_sort(F.collect_list(F.struct("c", "e"))), lambda x: x["e"]).alias("hot"))
    fresh = apart.join(common, "leader", "left").select("node", "leader", "part", "linked", "size", "of_leader", "added", "gone", "hot").mapInArrow(lean(post), "node long, leader long, part long, posts array<long>")
    fresh = fresh.select("node", "leader", "part", F.explode("posts").alias("e"))
    fresh = materialize(fresh.select(F.xxhash64("leader", F.shiftright("e", 2)).alias("key"), F.expr("shiftleft(1, cast(e & 3 as int))").alias("side"), "node", "part"), "posts")
    who = F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("who")
    mixed = fresh.groupBy("key").agg(F.count("*").alias("n"), who, F.bit_or("side").alias("sides"), *ends).where("low < high and sides in (3, 4)")
    # of buckets with the same members, one
    mixed = mixed.groupBy("n", "who").agg(F.min("key").alias("key")).select("key")
    active = materialize(fresh.select("key", "node", "part").join(mixed, "key"), "active")
    measured, split = done.select("node", "leader"), 1
    while count := active.count():
        slot = F.pmod(F.xxhash64("node", F.lit(split)), F.lit(split)) if split > 1 else F.lit(0)
        leaders = active.groupBy("key", slot.alias("slot")).agg(F.min(F.struct("node", "part")).alias("l")).select("key", F.col("l.node").alias("leader"), F.col("l.part").alias("of"))
        asked = active.join(leaders, "key").where("part <> of").select(F.greatest("node", "leader").alias("node"), F.least("node", "leader").alias("leader")).distinct()
        asked = materialize(asked.join(measured, ["node", "leader"], "left_anti"), "pairs")
        done = compared(asked.select("node", "leader", F.lit(False).alias("more"), F.lit(0).cast("long").alias("company")), asked.count())
        measured = measured.unionAll(done.select("node", "leader"))
        links = done.where("linked").select(F.col("node").alias("src"), F.col("leader").alias("dst"))
        if not links.isEmpty():
            parts = _merge(parts, links, count)
        # leaders have met all members; buckets whose other members are all connected are finished
        left = active.join(leaders.select("key", F.col("leader").alias("node")), ["key", "node"], "left_anti").select("key", "node")
        left = materialize(sized(grouped(left, parts), count), "rest")
        active = materialize(sized(left.join(left.groupBy("key").agg(*ends).where("low < high").select("key"), "key"), count), "active")
        split *= 4
    if parts is None:
        return nodes.select("node", F.col("doc_id").alias("class_id"), F.col("node").alias("class_key")), clashing
    least = parts.join(nodes.select("node", "doc_id"), "node").groupBy("component").agg(F.min("doc_id").alias("class_id"))
    of_node = parts.join(least, "component").select("node", "class_id", F.col("component").alias("class_key"))
    found = nodes.select("node", "doc_id").join(of_node, "node", "left").select(
        "node", F.when(F.col("class_key").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("class_key", "node").alias("class_key")
    )
    return found, clashing


def near_duplicates(docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """``node, class_id, class_key`` of each different text, see :func:`near_texts`."""
    return near_texts(docs, similar)[0]


def classes(docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """``doc_id, class_id, is_kept, class_key``: every row's near-duplicate class, named by its least doc_id.

    Similarity is the weighted Jaccard of 5-word shingle multisets, at least 0.8 by default; classes
    are the connected components of such links. Rows with equal texts are one node whatever their
    ids; null and empty texts are equal to each other and like no other text. ``is_kept`` marks the
    rows whose id names the class. One row per input row, repeated rows included; null ids name a
    class only if it has no other. Unrelated texts with null ids, or with one id, share a ``class_id``
    but not a ``class_key``, the least text hash of the class. Texts of any length are
    compared whole. Other columns are ignored. An empty table gives an empty result.
    """
    found, clashing = near_texts(docs, similar)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = with_nodes(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), text, clashing).select("doc_id", "node")
    named = rows.join(materialize(found, "classes"), "node")
    return named.select("doc_id", "class_id", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("is_kept"), "class_key")


def keep_one(docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """The rows of ``docs`` that name their class: one document of each, with its columns."""
    found, clashing = near_texts(docs, similar)
    named = materialize(found, "classes").select(F.col("node").alias("__node"), F.col("class_id").alias("__class"), F.col("class_key").alias("__key"))
    kept = with_nodes(docs, F.coalesce(F.col("text").cast("string"), F.lit("")), clashing, "__node").withColumn("__id", F.col("doc_id").cast("long"))
    kept = kept.join(named, (kept["__node"] == named["__node"]) & kept["__id"].eqNullSafe(named["__class"]), "left_semi")
    # repeated rows, or near texts of one id, leave several rows of a class: only then rows are compared
    several = kept.groupBy("__id").count().where("count > 1").limit(1).count()
    if several:
        kept = kept.join(named, "__node").dropDuplicates(["__key"])
    return kept.select(*docs.columns)
