"""Repetition rules from a word suffix array of each text.

Suffixes of all texts of a batch are ranked together by prefix doubling (a text's number is part of
its first ranks, so suffixes of different texts never meet). The longest common prefixes of
neighbours in that order are the intervals of maximal repeated substrings; a position's longest
repeat is the larger of its two neighbours' values. Spans of repeats are united, and the covered
share of words and the longest repeat are limited.
"""

from __future__ import annotations

from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from missiva.llm.token_count import slices

#: Repeats of at least so many words count; limits of the covered share of words and of the longest repeat.
LEAST_REPEAT, MOST_COVERED, MOST_REPEAT = 5, 0.5, 100
BATCH_CHARS = 2_000_000
SYMBOLS, SPACES = b"#*$%&|<>", b" \t\n\r\x0b\x0c"


def longest_repeats(words: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """For each word, the length of the longest run from it that also begins elsewhere in its text.

    ``words`` holds the numbers of the words of all texts in turn, ``lengths`` the words per text.
    """
    n = len(words)
    if n == 0:
        return np.zeros(0, dtype=np.int64)
    ends = np.repeat(np.cumsum(lengths), lengths)
    text = np.repeat(np.arange(len(lengths)), lengths)
    key = text * (int(words.max()) + 1) + words
    order = np.argsort(key, kind="stable")
    fresh = np.empty(n, dtype=bool)
    fresh[0], fresh[1:] = True, key[order[1:]] != key[order[:-1]]
    rank = np.empty(n, dtype=np.int64)
    rank[order] = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    levels = [rank.astype(np.int32)]
    size = np.bincount(rank, minlength=n)
    active = order[size[rank[order]] > 1]
    step = 1
    while len(active):
        ahead = active + step
        second = np.where(ahead < ends[active], rank[np.minimum(ahead, n - 1)] + 1, 0)
        first = rank[active]
        by = np.lexsort((second, first))
        active, first, second = active[by], first[by], second[by]
        place = np.arange(len(active))
        group = np.empty(len(active), dtype=bool)
        group[0], group[1:] = True, first[1:] != first[:-1]
        part = group.copy()
        part[1:] |= second[1:] != second[:-1]
        of_group = np.maximum.accumulate(np.where(group, place, 0))
        of_part = np.maximum.accumulate(np.where(part, place, 0))
        rank = rank.copy()
        rank[active] = first + (of_part - of_group)
        levels.append(rank.astype(np.int32))
        same = np.bincount(np.cumsum(part) - 1)
        active = active[same[np.cumsum(part) - 1] > 1]
        step *= 2
    order = np.empty(n, dtype=np.int64)
    order[rank] = np.arange(n)
    a, b = order[:-1], order[1:]
    pair = np.flatnonzero(text[a] == text[b])
    a, b = a[pair], b[pair]
    common = np.zeros(len(pair), dtype=np.int64)
    for k in range(len(levels) - 1, -1, -1):
        x, y = a + common, b + common
        inside = np.flatnonzero((x < ends[a]) & (y < ends[b]))
        level = levels[k]
        common[inside[level[x[inside]] == level[y[inside]]]] += 1 << k
    longest = np.zeros(n, dtype=np.int64)
    np.maximum.at(longest, a, common)
    np.maximum.at(longest, b, common)
    return longest


def covered(starts: np.ndarray, sizes: np.ndarray, n: int) -> np.ndarray:
    """Which of ``n`` positions the spans cover."""
    edge = np.zeros(n + 1, dtype=np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + sizes, -1)
    return np.cumsum(edge[:-1]) > 0


def judge(texts: list[str]) -> dict[str, np.ndarray]:
    """Rule values of each text."""
    raws = [t.encode("utf-8") for t in texts]
    every = [r.split() for r in raws]
    lengths = np.fromiter(map(len, every), dtype=np.int64, count=len(every))
    numbers, fresh = {}, count()
    words = np.fromiter((numbers.setdefault(w, i) for ws in every for w, i in zip(ws, fresh)), dtype=np.int64, count=int(lengths.sum()))
    longest = longest_repeats(words, lengths)
    n = len(words)
    owner = np.repeat(np.arange(len(texts)), lengths)
    total = lambda flags: np.bincount(owner[flags], minlength=len(texts))
    three = np.flatnonzero(longest >= 3)
    long = np.flatnonzero(longest >= LEAST_REPEAT)
    top = np.zeros(len(texts), dtype=np.int64)
    np.maximum.at(top, owner, longest)
    lines = [[x for x in r.split(b"\n") if x.strip(SPACES)] for r in raws]
    return {
        "n_words": lengths,
        "word_chars": np.array([len(t) - (len(r) - len(r.translate(None, SPACES))) for t, r in zip(texts, raws)], dtype=np.int64),
        "n_symbols": np.array([len(r) - len(r.translate(None, SYMBOLS)) for r in raws], dtype=np.int64),
        "n_dup_lines": np.array([len(x) - len(set(x)) for x in lines], dtype=np.int64),
        "n_repeat_words": total(covered(three, np.full(len(three), 3), n)),
        "n_covered_words": total(covered(long, longest[long], n)),
        "longest_repeat": top,
    }


def repetition_rules(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", most_covered: float = MOST_COVERED, most_repeat: int = MOST_REPEAT) -> DataFrame:
    """Word, symbol and repeat counts of every row, with the verdict.

    ``base_failed``: under 50 words, or over half of the words lie in 3-word windows found twice.
    ``kept``: not base_failed, repeats of 5 or more words cover at most ``most_covered`` of the
    words, and no repeat is longer than ``most_repeat`` words. One row per input row, repeated rows
    included; a null text has no words (all counts 0, base_failed), a null id stays null, other
    columns are ignored. Texts of any length are handled whole. No shuffle.
    """
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

    def run(batches):
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for s in slices(texts, BATCH_CHARS):
                v = judge(texts[s])
                n, repeat = v["n_words"], v["n_repeat_words"]
                failed = (n < 50) | (100 * repeat > 50 * n)
                share = v["n_covered_words"] / np.maximum(n, 1)
                keep = ~failed & (share <= most_covered) & (v["longest_repeat"] <= most_repeat)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(s.start, s.stop - s.start), *(pa.array(v[c], pa.int64()) for c in counts), pa.array(failed), pa.array(keep), pa.array(v["n_covered_words"], pa.int64()), pa.array(v["longest_repeat"], pa.int64())],
                    names=["doc_id", *counts, "base_failed", "kept", "n_covered_words", "longest_repeat"],
                )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, " + ", ".join(f"{c} long" for c in counts) + ", base_failed boolean, kept boolean, n_covered_words long, longest_repeat long")


#: The same rules by windows of words. A repeat is longer than 100 words where a window of 101 is found twice.
SQL = r"""
with docs as (select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
lines as (select doc_id, sum(n - 1) as dup from (
  select doc_id, line, count(*) as n from (select doc_id, unnest(string_split(text, chr(10))) as line from docs) a
  where len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) > 0 group by 1, 2) b group by doc_id),
spots as (select doc_id, w, len(w) as n, unnest(range(1, len(w) + 1)) as i from docs where len(w) > 0),
win as (select doc_id, n, i,
  case when i + 2 <= n then array_to_string(w[i:i + 2], ' ') end as w3,
  case when i + 4 <= n then array_to_string(w[i:i + 4], ' ') end as w5,
  case when i + 100 <= n then md5(array_to_string(w[i:i + 100], ' ')) end as w101 from spots),
rep as (select doc_id, i,
  case when w3 is not null and count(*) over (partition by doc_id, w3) > 1 then 1 else 0 end as r3,
  case when w5 is not null and count(*) over (partition by doc_id, w5) > 1 then 1 else 0 end as r5,
  case when w101 is not null and count(*) over (partition by doc_id, w101) > 1 then 1 else 0 end as r101 from win),
cov as (select doc_id, max(r3) over (partition by doc_id order by i rows between 2 preceding and current row) as c3,
  max(r5) over (partition by doc_id order by i rows between 4 preceding and current row) as c5, r101 from rep),
s as (select doc_id, sum(c3) as c3, sum(c5) as c5, max(r101) as r101 from cov group by doc_id)
select d.doc_id, cast(len(d.w) as bigint) as n_words, cast(length(array_to_string(d.w, '')) as bigint) as word_chars,
  cast(length(d.text) - length(regexp_replace(d.text, '[#*$%&|<>]', '', 'g')) as bigint) as n_symbols, cast(coalesce(l.dup, 0) as bigint) as n_dup_lines,
  cast(coalesce(s.c3, 0) as bigint) as n_repeat_words, len(d.w) < 50 or 100 * coalesce(s.c3, 0) > 50 * len(d.w) as base_failed,
  not (len(d.w) < 50 or 100 * coalesce(s.c3, 0) > 50 * len(d.w)) and 2 * coalesce(s.c5, 0) <= len(d.w) and coalesce(s.r101, 0) = 0 as kept,
  cast(coalesce(s.c5, 0) as bigint) as n_covered_words
from docs d left join lines l on l.doc_id = d.doc_id left join s on s.doc_id = d.doc_id
"""
