"""Stale threads as a stream: a thread is told of once when it has changed since its record was made."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Kinds of events.
MESSAGE, FILE, RECORD = "message", "file", "record"
EVENT = "thread string, kind string, day string, n long, attach long, at timestamp"
STATE = "threads binary, timer long"
RESULT = "thread string, n long, end string, attach long"
#: Groups of threads by a digest of their name; each has one state.
BUCKETS = 4096
#: A thread's signature, that of its newest record, whether it was told of since, and when it is due to be compared (times in milliseconds).
THREAD = pa.schema([("thread", pa.string()), ("n", pa.int64()), ("end", pa.string()), ("attach", pa.int64()), ("rec_at", pa.int64()), ("rec_n", pa.int64()), ("rec_end", pa.string()), ("rec_attach", pa.int64()), ("told", pa.bool_()), ("due", pa.int64())])


def _packed(threads: pd.DataFrame) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, THREAD) as out:
        out.write_table(pa.Table.from_pandas(threads, THREAD, preserve_index=False))
    return sink.getvalue().to_pybytes()


def _unpacked(data: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(data).read_all().to_pandas(types_mapper={pa.int64(): pd.Int64Dtype()}.get)


def _reduced(rows: pd.DataFrame) -> pd.DataFrame:
    """One row a thread: counts summed, latest day and time, and the newest record (of several at one time the last)."""
    rows = rows.reset_index(drop=True)
    thread, names = pd.factorize(rows["thread"])
    days, day = np.unique(rows["end"].to_numpy(object), return_inverse=True)
    by = pd.DataFrame({"n": rows["n"], "attach": rows["attach"], "latest": rows["latest"], "day": day}).groupby(thread)
    out = by.agg({"n": "sum", "attach": "sum", "latest": "max", "day": "max"}).sort_index()
    out["thread"], out["end"] = np.asarray(names, object), days[out.pop("day").to_numpy()]
    made = rows[rows["rec_at"].notna()].sort_values("rec_at", kind="stable").drop_duplicates("thread", keep="last")
    return out.merge(made[["thread", "rec_at", "rec_n", "rec_end", "rec_attach", "told"]], "left", "thread")


def _partial(part: pd.DataFrame) -> pd.DataFrame:
    """What the events of one batch say of their threads."""
    kind, at = part["kind"].to_numpy(object), part["at"].to_numpy("datetime64[ms]").astype("int64")
    day = part["day"].where(part["day"].notna(), "").to_numpy(object)
    message, record = kind == MESSAGE, (kind != MESSAGE) & (kind != FILE)
    whole = lambda c: part[c].fillna(0).astype("Int64").where(record)
    return _reduced(pd.DataFrame({
        "thread": part["thread"].to_numpy(object), "n": message.astype("int64"), "end": np.where(message, day, ""), "attach": (kind == FILE).astype("int64"), "latest": at,
        "rec_at": pd.array(at, "Int64"), "rec_n": whole("n").array, "rec_end": np.where(record, day, None), "rec_attach": whole("attach").array, "told": False,
    }).assign(rec_at=lambda x: x["rec_at"].where(record)))


class StaleThreads(StatefulProcessor):
    """One state per bucket of threads: per thread its signature (messages, latest day, files), that of its newest record, and whether it was told of since.

    Several changes within ``settle`` milliseconds are told as one: each puts off the time at which the signatures
    are compared. A bucket has one timer, for the thread that is due first.
    """

    def __init__(self, settle: int):
        self.settle = settle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("threads", STATE)

    def _read(self) -> tuple[pd.DataFrame, int | None]:
        known = self.state.get()
        return (_unpacked(bytes(known[0])), known[1]) if known else (THREAD.empty_table().to_pandas(types_mapper={pa.int64(): pd.Int64Dtype()}.get), None)

    def _write(self, threads: pd.DataFrame, timer: int | None) -> None:
        """Keep the threads; the timer is set to the first that is due."""
        due = threads["due"].min()
        due = None if pd.isna(due) else int(due)
        if due != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if due is not None:
                self.handle.registerTimer(due)
        self.state.update((_packed(threads), due))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        old, timer = self._read()
        new = _reduced(pd.concat([_partial(part) for part in rows]))
        both = _reduced(pd.concat([old.assign(latest=0)[new.columns], new]))
        both = both.merge(old[["thread", "due"]], "left", "thread").astype({"due": "Int64"})
        both = both.fillna({"rec_n": 0, "rec_end": "", "rec_attach": 0}).assign(told=both["told"].eq(True))
        # a thread that was spoken of, has a record and was not told of since is due anew
        again = both["thread"].isin(new["thread"]) & both["rec_at"].notna() & ~both["told"]
        both["due"] = both["due"].mask(again, both["latest"].clip(lower=timerValues.getCurrentWatermarkInMs()) + self.settle)
        self._write(both[THREAD.names], timer)
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        threads, timer = self._read()
        fired = expiredTimerInfo.getExpiryTimeInMs()
        now = ((threads["due"] <= fired) | (threads["due"] < timerValues.getCurrentWatermarkInMs())).fillna(False).astype(bool)
        differs = (threads["n"] != threads["rec_n"]) | (threads["end"] != threads["rec_end"]) | (threads["attach"] != threads["rec_attach"])
        found = now & differs.astype(bool) & ~threads["told"]
        threads["told"], threads["due"] = threads["told"] | found, threads["due"].mask(now)
        self._write(threads, None if timer == fired else timer)
        yield threads.loc[found, ["thread", "n", "end", "attach"]].astype({"n": "int64", "attach": "int64"})

    def close(self) -> None:
        pass


def stale_stream(events: DataFrame, settle_seconds: int = 3600, late: str = "10 days", buckets: int = BUCKETS) -> DataFrame:
    """Threads of a stream of events that no longer match their newest record, with their signature now; once per record.

    ``events`` has the columns of ``EVENT``: a message counts and moves the thread's latest day (also one that is
    older than others, as its place in time is ``at``, when it arrived), a file counts as an
    attachment, a record brings the signature (``n``, ``day``, ``attach``) that it was made from. Threads without a
    record are never stale. ``settle_seconds`` after the last change, by the watermark, the
    signatures are compared; events more than ``late`` behind the newest are dropped. Each message
    and file is expected once (see :mod:`missiva.streaming.ingest`). Rows without a thread are left out.
    Threads are kept in ``buckets`` states, each read and written as a whole: far fewer calls than threads, but a
    batch rewrites the buckets that it touches. The number cannot be changed under a checkpoint.
    """
    rows = events.where("thread is not null").withWatermark("at", late)
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("thread"), F.lit(buckets)).cast("int"))
    return rows.groupBy("bucket").transformWithStateInPandas(StaleThreads(1000 * settle_seconds), outputStructType=RESULT, outputMode="Append", timeMode="EventTime")
