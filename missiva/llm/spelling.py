"""Spelling variants by asymmetric chunks: words one edit apart, joined without comparing all pairs.

Of two words one edit apart the longer contributes disjoint chunks, the other its grams at the same
places, shifted by one where it lacks a character. The edit spoils one of two chunks only, so an
equi-join on (chunk, place, lengths) finds every pair. A half of a word is shared by very many words
of a language, so the other half, which holds the edit, contributes two chunks again: a key is the
whole half and the whole quarter that the edit leaves, and candidates can differ only within the
quarter between. A candidate is verified there.
"""

from __future__ import annotations

import zlib
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from missiva.session import materialize, small_batches

#: Words have at least so many code points and so many occurrences; a form is so many times as frequent.
LEAST_LENGTH, LEAST_COUNT, TIMES = 5, 3, 2
#: One occurrence in so many is misspelt on purpose.
PLANTED = 97
#: Words that a task counts before it passes them on.
HELD = 200_000

#: Latin-1 byte to itself if it belongs to a word (A to Z in lower case), else to a blank.
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 0xC0 else 32 for c in range(256))


def words_of(doc_id: int | None, text: str) -> Counter:
    """Occurrences of each lower-cased word of a text (in Latin-1), the planted misspellings made."""
    counts = Counter(text.encode("latin-1", "replace").translate(_LETTERS).split())
    begin = zlib.crc32(b":" if doc_id is None else b"%d:" % doc_id)
    changed = []
    for word in counts:
        h = zlib.crc32(word if word.isascii() else word.decode("latin-1").encode(), begin)
        if h % PLANTED == 0:
            k = h % len(word)
            changed.append((word, word[:k] + word[k + 1 :]))
    for word, n, made in [(word, counts.pop(word), made) for word, made in changed]:
        counts[made] += n
    return counts


def vocabulary(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """``word, n``: the words of all texts, counted per slice of texts before they are shuffled."""
    small_batches(docs.sparkSession)

    def flushed(held: Counter) -> pa.RecordBatch:
        words = [w.decode("latin-1") for w in held]
        return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])

    def run(batches):
        held: Counter = Counter()
        for batch in batches:
            for i in range(batch.num_rows):
                for word, n in words_of(batch.column(0)[i].as_py(), batch.column(1)[i].as_py() or "").items():
                    if len(word) >= least_length:
                        held[word] += n
                if len(held) > HELD:
                    yield flushed(held)
                    held.clear()
        yield flushed(held)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def _quarters(length: Column) -> list[tuple[Column, Column]]:
    """Begin and end of the quarters of a word: its halves, halved."""
    half = F.floor(length / 2)
    at = [F.lit(0), F.floor(half / 2), half, half + F.floor((length - half) / 2), length]
    return [(a.cast("int"), b.cast("int")) for a, b in zip(at, at[1:])]


def _kept(word: Column, begin: Column, end: Column) -> tuple[Column, Column]:
    """The word before ``begin`` and from ``end`` on."""
    return F.substring(word, F.lit(1), begin), F.substring(word, end + 1, F.length(word))


def _keys(longer: bool) -> Column:
    """Keys of ``word`` as the one with the chunks, with the quarter left out, or as the one with the grams."""
    word, size = F.col("word"), F.length("word")
    keys = []
    for missing in (0, 1):
        length = size if longer else size + missing
        for k, (begin, end) in enumerate(_quarters(length)):
            key = F.xxhash64(F.lit(k), F.lit(missing), length, *_kept(word, begin, end if longer else end - missing)).alias("key")
            keys.append(F.struct(key, F.lit(missing).alias("missing"), begin.alias("begin"), end.alias("end")) if longer else F.struct(key))
    return F.explode(F.array(*keys))


def shuffled(df: DataFrame) -> DataFrame:
    """``df``, whose next join is a sort-merge join.

    Spark goes by the size of a table's files, which is a small part of what a driver would hold of them: words are packed
    there, and an explode counts as if it gave one row for one.
    """
    return df.hint("merge")


def near_pairs(words: DataFrame) -> DataFrame:
    """Pairs of different words of ``word, n`` that are one inserted, deleted or replaced code point apart, each once.

    ``a`` is the longer, or of equal lengths the smaller, word. A pair is found under the quarter that
    holds its edit; of a run of equal characters the first counts as the missing one.
    """
    a = words.select(F.col("word").alias("a"), F.col("n").alias("n_a"), _keys(True).alias("x")).select("a", "n_a", "x.*")
    b = words.select(F.col("word").alias("b"), F.col("n").alias("n_b"), _keys(False).alias("x")).select("b", "n_b", "x.*")
    missing, begin, end = F.col("missing"), F.col("begin"), F.col("end")
    rest = end - begin - 1
    earlier = (missing == 1) & (begin > 0) & (F.substring("a", begin, F.lit(1)) == F.substring("a", begin + 1, F.lit(1))) & (F.substring("a", begin + 2, rest) == F.substring("b", begin + 1, rest))
    (left_a, right_a), (left_b, right_b) = _kept(F.col("a"), begin, end), _kept(F.col("b"), begin, end - missing)
    met = shuffled(a).join(b, "key").where((missing == 1) | (F.col("a") < F.col("b")))
    found = (F.levenshtein("a", "b", 1) == 1) & ~earlier & (F.length("b") + missing == F.length("a")) & (left_a == left_b) & (right_a == right_b)
    return met.where(found).select("a", "n_a", "b", "n_b")


def with_roots(forms: DataFrame) -> DataFrame:
    """``word, form`` with ``root``, the end of the chain of forms, by pointer jumping.

    Forms at least double the count, so that chains are short and few rounds reach every end.
    """
    steps = materialize(forms.where("form IS NOT NULL").select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = steps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = materialize(shuffled(steps).join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        steps = moved.drop("moved")
        if not moved.where("moved").limit(1).count():
            return shuffled(forms).join(steps, "word", "left").withColumn("root", F.coalesce("root", "word"))


def variants(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, times: int = TIMES) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every frequent word of all texts.

    ``form`` is the most frequent word one edit away (of equals the first in code-point order), if it
    is at least ``times`` times as frequent, else null; ``root`` the end of the chain of forms. Words
    are runs of basic and Latin-1 letters, whole texts are read, nulls count as empty; a null id
    counts as empty in the check sum that plants misspellings; rows that repeat count as often as
    they are there; other columns are ignored. Runs of any length are words. No word gives an
    empty result.
    """
    words = materialize(vocabulary(docs, id_col=id_col, text_col=text_col, least_length=least_length, least_count=least_count), "vocabulary")
    pairs = near_pairs(words)
    both = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("n_b").alias("m")), F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("n_a").alias("m")))).alias("x")).select("x.*")
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "near")).alias("top"))
    taken = -F.col("top.m") >= times * F.col("n")
    forms = shuffled(words).join(best, "word", "left").select("word", F.when(taken, F.col("top.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(taken, -F.col("top.m")).alias("form_n"))
    return with_roots(materialize(forms, "forms")).select("word", "form", "root", "n", "n_near", "form_n")
