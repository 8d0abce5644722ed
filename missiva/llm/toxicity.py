"""Toxicity: bidirectional gated recurrent network with attention pooling, trained in numpy.

A word's input joins an embedding of the word and one of its character n-grams (both hashed). Two
gated recurrent layers read each window of words in either direction, attention pools their states,
and a logistic unit scores the pooled state. All overlapping windows of a text are scored and the
largest counts. Training sees whole texts too: the windows of a text share its label through a
smooth maximum, so that the window that carries the evidence gets most of the gradient.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from missiva.llm.quality import held_out
from missiva.llm.near_dup import cuts
from missiva.session import held, lean, materialize, small_batches

#: Words per window and between windows; sizes of the hashed tables, the embeddings and the states.
WINDOW, STRIDE = 40, 20
#: A run of more characters without white space counts as overlapping pieces of so many, each a word; characters between their starts.
PIECE, PIECE_STEP = 64, 48
WORDS, GRAM_BITS, WORD_DIM, GRAM_DIM, HIDDEN, ATTEND = 1 << 12, 15, 6, 10, 8, 8
#: The fit: at most so many labelled texts of either kind, chosen by hash of the id; of these the ones of over FIT_WORDS words are left out.
FIT_POSITIVE, FIT_NEGATIVE, FIT_WORDS = 2000, 2500, 600
STEPS, TEXTS_A_STEP, RATE, SEED = 330, 40, 0.02, 7
BATCH_BYTES, BATCH_WINDOWS, REMEMBERED = 250_000, 2048, 60_000
EDGE = " \t\n\r\x0b\x0c.,;:!?\"'()[]{}|*#$%&<>-_~`^+=/\\"


def words_of(text: str) -> list[str]:
    """Words in lower case, long runs in overlapping pieces: every n-gram, and every stretch of up to 17 characters, lies whole in one."""
    words = text.lower().split()
    if max(map(len, words), default=0) <= PIECE:
        return words
    return [w[at : at + PIECE] for w in words for at in range(0, max(1, len(w) - PIECE + PIECE_STEP), PIECE_STEP)]


def word_features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed numbers of words, hashed numbers of their byte 4- and 5-grams, and the grams per word."""
    raws = [b"<" + w.strip(EDGE).encode("utf-8") + b">>>>" for w in words]
    size = np.fromiter(map(len, raws), dtype=np.int64, count=len(raws)) - 4
    byte = np.frombuffer(b"".join(raws), dtype=np.uint8).astype(np.uint64)
    begin = np.repeat(np.cumsum(size + 4) - (size + 4), size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    four = byte[begin] | byte[begin + 1] << np.uint64(8) | byte[begin + 2] << np.uint64(16) | byte[begin + 3] << np.uint64(24)
    both = np.stack([four, four | byte[begin + 4] << np.uint64(32) | np.uint64(1 << 40)], axis=1).ravel()
    grams = (both * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - GRAM_BITS)
    return np.array([zlib.crc32(r) % WORDS for r in raws], dtype=np.int64), grams.astype(np.int64), 2 * size


class Lexicon:
    """Numbers for words, with their features; number 0 is the padding."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {"": 0}
        self.fresh: list[str] = [""]

    def ids(self, words: list[str]) -> list[int]:
        number = self.number
        for w in set(words).difference(number):
            number[w] = len(number)
            self.fresh.append(w)
        return list(map(number.__getitem__, words))

    def features(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Word numbers, gram numbers and gram counts of the words not yet asked for."""
        fresh, self.fresh = self.fresh, []
        return word_features(fresh)


def windows(ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """All overlapping windows, zero-padded, and the number of windows of each text (0 if it has no word)."""
    n = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
    per = np.where(n == 0, 0, 1 + np.maximum(0, -(-(n - WINDOW) // STRIDE)))
    flat = np.fromiter((i for x in ids for i in x), dtype=np.int32, count=int(n.sum()))
    flat = np.concatenate([flat, np.zeros(WINDOW, dtype=np.int32)])
    begin = np.repeat(np.cumsum(n) - n, per) + STRIDE * (np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per))
    stop = np.repeat(np.cumsum(n), per)
    at = begin[:, None] + np.arange(WINDOW)
    out = flat[np.minimum(at, len(flat) - 1)]
    out[at >= stop[:, None]] = 0
    return out, per


def _soft(x: np.ndarray) -> np.ndarray:
    """Squashing function x / (1 + |x|), in place: much cheaper than tanh and as easy to train. Its slope is (1 - |y|)^2."""
    d = np.abs(x)
    d += 1
    x /= d
    return x


def _gate(x: np.ndarray) -> np.ndarray:
    """Squashed to 0..1, in place; its slope is 2 min(y, 1 - y)^2."""
    x = _soft(x)
    x *= 0.5
    x += 0.5
    return x


def _slope(y: np.ndarray) -> np.ndarray:
    return 2 * np.minimum(y, 1 - y) ** 2


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Network:
    """Parameters and passes. States are batch-major float32; gates in the order reset, update, new."""

    def __init__(self, seed: int = SEED):
        rng = np.random.default_rng(seed)
        d, h = WORD_DIM + GRAM_DIM, HIDDEN
        init = lambda *shape: (rng.normal(size=shape) * np.sqrt(1 / shape[0])).astype(np.float32)
        self.p = {
            "word": (rng.normal(size=(WORDS, WORD_DIM)) * 0.1).astype(np.float32),
            "gram": (rng.normal(size=(1 << GRAM_BITS, GRAM_DIM)) * 0.3).astype(np.float32),
            "x0": init(d, 3 * h), "x1": init(d, 3 * h), "h0": init(h, 3 * h), "h1": init(h, 3 * h),
            "b0": np.zeros(3 * h, np.float32), "b1": np.zeros(3 * h, np.float32),
            "a": init(2 * h, ATTEND), "ab": np.zeros(ATTEND, np.float32), "v": init(ATTEND), "o": init(2 * h), "ob": np.array([-1.0], np.float32),
        }

    def inputs(self, word: np.ndarray, gram: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Joined embeddings of words."""
        begin = np.cumsum(size) - size
        grams = np.add.reduceat(self.p["gram"][gram], begin, axis=0) / np.sqrt(size)[:, None] if len(size) else np.zeros((0, GRAM_DIM))
        return np.hstack([self.p["word"][word], grams]).astype(np.float32)

    def gates(self, x: np.ndarray) -> list[np.ndarray]:
        """Input parts of the gates of both directions, one contiguous table each."""
        h = HIDDEN
        return [np.ascontiguousarray((x @ self.p[f"x{k}"] + self.p[f"b{k}"])[:, g * h : g * h + h]) for k in (0, 1) for g in range(3)]

    def forward(self, gates: list[np.ndarray], w: np.ndarray, keep: bool = False):
        """Logit of each window (rows of word numbers); with ``keep`` also what the backward pass needs."""
        n, h = len(w), HIDDEN
        states = np.empty((WINDOW, n, 2 * h), dtype=np.float32)
        kept = {}
        cols = np.ascontiguousarray(w.T)
        for k in (0, 1):
            ur, uz, un = (np.ascontiguousarray(self.p[f"h{k}"][:, g * h : g * h + h]) for g in range(3))
            s = np.zeros((n, h), dtype=np.float32)
            for t in range(WINDOW) if k == 0 else range(WINDOW - 1, -1, -1):
                at = cols[t]
                r, z, new = (np.take(gates[3 * k + g], at, axis=0, mode="clip") for g in range(3))
                r += s @ ur
                z += s @ uz
                m = s @ un
                r, z = _gate(r), _gate(z)
                new += r * m
                new = _soft(new)
                if keep:
                    kept[k, t] = s, r, z, new, m
                s = s - new
                s *= z
                s += new
                states[t, :, k * h : k * h + h] = s
        e = _soft(states @ self.p["a"] + self.p["ab"])
        score = e @ self.p["v"]
        score[cols == 0] = -1e9
        alpha = np.exp(score - score.max(axis=0))
        alpha /= alpha.sum(axis=0)
        pooled = (alpha[:, :, None] * states).sum(axis=0)
        logit = pooled @ self.p["o"] + self.p["ob"][0]
        return (logit, states, e, alpha, pooled, cols, kept) if keep else logit

    def backward(self, gates, passed, d_logit: np.ndarray):
        """Gradients of the parameters above the gates, and of the gate tables."""
        _, states, e, alpha, pooled, cols, kept = passed
        h, p, grad = HIDDEN, self.p, {}
        grad["o"], grad["ob"] = pooled.T @ d_logit, np.array([d_logit.sum()])
        d_pooled = d_logit[:, None] * p["o"]
        d_alpha = np.einsum("tnh,nh->tn", states, d_pooled)
        d_states = alpha[:, :, None] * d_pooled
        d_score = alpha * (d_alpha - (alpha * d_alpha).sum(axis=0))
        grad["v"] = np.einsum("tnk,tn->k", e, d_score)
        d_e = d_score[:, :, None] * p["v"] * (1 - np.abs(e)) ** 2
        grad["ab"] = d_e.sum(axis=(0, 1))
        grad["a"] = states.reshape(-1, 2 * h).T @ d_e.reshape(-1, ATTEND)
        d_states += d_e @ p["a"].T
        tables = []
        for k in (0, 1):
            u, d_s = p[f"h{k}"], np.zeros((states.shape[1], h), dtype=np.float32)
            d_u, d_gates = np.zeros_like(u), np.empty((WINDOW, states.shape[1], 3 * h), dtype=np.float32)
            for t in range(WINDOW - 1, -1, -1) if k == 0 else range(WINDOW):
                s, r, z, new, m = kept[k, t]
                d_s = d_s + d_states[t, :, k * h : k * h + h]
                d_new = d_s * (1 - z) * (1 - np.abs(new)) ** 2
                d_z = d_s * (s - new) * _slope(z)
                d_r = d_new * m * _slope(r)
                d_gates[t] = np.hstack([d_r, d_z, d_new])
                d_m = np.hstack([d_r, d_z, d_new * r])
                d_u += s.T @ d_m
                d_s = d_s * z + d_m @ u.T
            grad[f"h{k}"] = d_u
            flat, rows = cols.ravel(), d_gates.reshape(-1, 3 * h)
            order = np.argsort(flat, kind="stable")
            present, first = np.unique(flat[order], return_index=True)
            table = np.zeros((len(gates[0]), 3 * h), dtype=np.float32)
            table[present] = np.add.reduceat(rows[order], first, axis=0)
            grad[f"b{k}"] = table.sum(axis=0)
            tables.append(table)
        return grad, tables


def fit(texts: list[str], labels: np.ndarray, steps: int = STEPS) -> Network:
    """Train on whole texts. Fixed work whatever the number of texts; half of each step's texts are toxic."""
    net, rng, lexicon = Network(), np.random.default_rng(SEED), Lexicon()
    ids = [np.array(lexicon.ids(words_of(t)), dtype=np.int64) for t in texts]
    word, gram, size = lexicon.features()
    begin = np.cumsum(size) - size
    kinds = [[i for i in np.flatnonzero(labels == k) if len(ids[i])] for k in (1, 0)]
    moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}
    prior = min(0.45, max(0.02, float(np.mean(labels))))
    for step in range(1, steps + 1):
        chosen = [i for kind in kinds for i in rng.choice(kind, size=TEXTS_A_STEP // 2)]
        y = np.array([labels[i] for i in chosen], dtype=np.float32)
        w, per = windows([ids[i].tolist() for i in chosen])
        used, local = np.unique(np.concatenate([[0], w.ravel()]), return_inverse=True)
        w = local[1:].reshape(w.shape).astype(np.int32)
        grams = np.concatenate([gram[begin[u] : begin[u] + size[u]] for u in used])
        x = net.inputs(word[used], grams, size[used])
        gates = net.gates(x)
        passed = net.forward(gates, w, keep=True)
        logit = passed[0]
        first = np.cumsum(per) - per
        top = np.maximum.reduceat(logit, first)
        weight = np.exp(2 * (logit - np.repeat(top, per)))
        weight /= np.repeat(np.add.reduceat(weight, first), per)
        pooled = np.add.reduceat(weight * logit, first)
        # positives are over-represented here; weights restore a moderate base rate
        d_text = (_sigmoid(pooled) - y) * np.where(y > 0, 0.6, 1.4) / len(y)
        grad, tables = net.backward(gates, passed, (np.repeat(d_text, per) * weight).astype(np.float32))
        d_x = sum(tables[k] @ net.p[f"x{k}"].T for k in (0, 1))
        for k in (0, 1):
            grad[f"x{k}"] = x.T @ tables[k]
        d_word, d_gram = np.zeros_like(net.p["word"]), np.zeros_like(net.p["gram"])
        np.add.at(d_word, word[used], d_x[:, :WORD_DIM])
        spread = np.repeat(d_x[:, WORD_DIM:] / np.sqrt(size[used])[:, None], size[used], axis=0)
        by = np.argsort(grams, kind="stable")
        present, at = np.unique(grams[by], return_index=True)
        d_gram[present] = np.add.reduceat(spread[by], at, axis=0)
        grad["word"], grad["gram"] = d_word, d_gram
        rate = RATE * min(1.0, step / 20) * (0.05 + 0.95 * (1 - step / steps))
        for k, g in grad.items():
            m, v = moment[k]
            if k in ("word", "gram"):  # sparse rows: accumulated squares only
                v += g * g
                net.p[k] -= (8 * rate * g / (np.sqrt(v) + 1e-4)).astype(np.float32) * 0.5
                continue
            m *= 0.9
            m += 0.1 * g
            v *= 0.99
            v += 0.01 * g * g
            net.p[k] -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)).astype(net.p[k].dtype)
    net.prior = prior
    return net


class Scorer:
    """Scores lists of texts, keeping the gate rows of the words seen."""

    def __init__(self, net: Network):
        self.net, self.lexicon = net, Lexicon()
        self.forget()

    def forget(self) -> None:
        """Words seen so far."""
        self.lexicon.clear()
        self.tables = [np.zeros((0, HIDDEN), np.float32)] * 6

    def _learn(self) -> None:
        """Gate rows of words that have none yet; the tables double when they are full."""
        begin, end = len(self.lexicon.number) - len(self.lexicon.fresh), len(self.lexicon.number)
        if begin == end:
            return
        rows = self.net.gates(self.net.inputs(*self.lexicon.features()))
        for k in range(6):
            if len(self.tables[k]) < end:
                grown = np.zeros((max(end, 2 * len(self.tables[k])), HIDDEN), np.float32)
                grown[:begin] = self.tables[k][:begin]
                self.tables[k] = grown
            self.tables[k][begin:end] = rows[k]

    def __call__(self, texts: list[str]) -> np.ndarray:
        out = np.full(len(texts), self.net.prior)
        if len(self.lexicon.number) > REMEMBERED:
            self.lexicon.clear()
        w, per = windows([self.lexicon.ids(words_of(t)) for t in texts])
        self._learn()
        logit = np.concatenate([self.net.forward(self.tables, w[i : i + BATCH_WINDOWS]) for i in range(0, len(w), BATCH_WINDOWS)] or [np.zeros(0)])
        has = np.flatnonzero(per)
        if len(has):
            out[has] = _sigmoid(np.maximum.reduceat(logit, (np.cumsum(per) - per)[has]).astype(np.float64))
        return out


def training_sample(docs: DataFrame, labels: DataFrame, label_col: str = "toxic") -> tuple[list[str], np.ndarray]:
    """Bounded sample of labelled, not held-out texts: the first by hash of the id, of either label."""
    truth = labels.where(F.col(label_col).isNotNull() & ~held_out()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(label_col).cast("int").alias("y"))
    first = F.xxhash64("doc_id", F.lit(SEED))
    chosen = [r for y, n in ((1, FIT_POSITIVE), (0, FIT_NEGATIVE)) for r in truth.where((F.col("y") > 0) == bool(y)).orderBy(first, "doc_id").limit(n).select("doc_id", F.lit(y).alias("y")).collect()]
    if not chosen:
        return [], np.zeros(0, dtype=int)
    spark = docs.sparkSession
    ids = F.broadcast(spark.createDataFrame([tuple(r) for r in chosen], "doc_id long, y int"))  # at most FIT_POSITIVE + FIT_NEGATIVE rows
    # only the chosen texts are counted: the join is written before the filter, which would be pushed below it
    few = materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(ids, "doc_id"), "labelled")
    few = few.where(F.regexp_count("text", F.lit(rf"(?<!\S)\S{{1,{PIECE}}}|\S{{1,{PIECE_STEP}}}")).between(1, FIT_WORDS))
    rows = few.orderBy(first, "doc_id", "text").limit(FIT_POSITIVE + FIT_NEGATIVE).collect()
    return [r.text for r in rows], np.array([r.y for r in rows], dtype=int)


def score_toxicity(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.5, label_col: str = "toxic", keep: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row, and the columns of ``docs`` named in ``keep``, under names with ``keep_`` in front.

    Learned from a bounded sample of labelled rows that are not held out. Without labels of both
    kinds every score is 0. Every text is scored whole, over all its overlapping windows. Null and
    empty texts, and texts without a word, get the sample's share of toxic texts (below 0.45). One
    row per input row, repeated rows included; a null id stays null and is held out; ties share a
    score; other columns are ignored. An empty table gives an empty result.
    """
    texts, y = training_sample(docs, labels, label_col)
    kinds = {int(k) for k, t in zip(y, texts) if t.split()}
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("text").cast("string").alias("keep_text"), *(F.col(c).alias(f"keep_{c}") for c in keep if c != "text"))
    extra = [(c, rows.schema[f"keep_{c}"].dataType.simpleString()) for c in keep]
    if kinds != {0, 1}:
        return rows.select("doc_id", "held_out", F.lit(0.0).alias("score"), F.lit(0).alias("predicted"), *(F.col(f"keep_{c}") for c in keep))
    small_batches(docs.sparkSession, "2m")
    net = docs.sparkSession.sparkContext.broadcast(fit(texts, y))
    key = uuid.uuid4().hex
    scorer_of = lambda: held(key, lambda: Scorer(net.value))

    def run(batches):
        scorer = scorer_of()
        for batch in batches:
            for s in cuts(batch.column(2), BATCH_BYTES):
                part = batch.slice(s.start, s.stop - s.start)
                p = scorer([t or "" for t in part.column(2).to_pylist()])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(p), pa.array((p >= threshold).astype(np.int32)), *(part.column(f"keep_{c}") for c in keep)],
                    names=["doc_id", "held_out", "score", "predicted", *(f"keep_{c}" for c in keep)],
                )

    return rows.mapInArrow(lean(run, lambda: scorer_of().forget()), ", ".join(["doc_id long", "held_out boolean", "score double", "predicted int", *(f"`keep_{c}` {t}" for c, t in extra)]))
