"""Incremental ingest with Structured Streaming: every key once, whatever arrives again."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from missiva.session import scratch_dir
from missiva.sources.manifest import add_entry, last_entry

#: Parts of a store by a digest of the key; a batch reads the keys of the parts that it touches.
BUCKETS = 64
BUCKET, PLACE = "__bucket", "__place"


def _keyed(keys: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, (F.col(k).isNotNull() for k in keys))


def _parts(spark: SparkSession, store: str, schema, names: Sequence[str]) -> DataFrame:
    """The rows of some batches of a store, with their bucket."""
    rows = spark.createDataFrame([], schema).withColumn(BUCKET, F.lit(0))
    if names:
        rows = spark.read.schema(rows.schema).option("basePath", store).parquet(*(f"{store}/{n}" for n in names)).select(*rows.columns)
    return rows


def read_store(spark: SparkSession, store: str, schema) -> DataFrame:
    """All rows that batches have committed to a store; what an attempt left behind is not read."""
    return _parts(spark, store, schema, last_entry(spark, store)[1].get("parts", [])).drop(BUCKET)


def add_once(batch: DataFrame, keys: Sequence[str], store: str, writer: str, number: int, buckets: int = BUCKETS) -> DataFrame:
    """Add the rows of ``batch`` (no column named ``__bucket``, ``__part`` or ``__place``) whose keys the store does not hold, each key once; the rows that were added.

    Rows with a null in a key column have no key and all come in. A batch is known by its ``writer``
    and ``number``, which grows: run again after it was committed, it adds nothing and gives its
    rows anew; run again after it failed, what it had written is not part of the store. Several
    writers may add to one store: a batch that finds another committed before it is checked against
    that one too. Keys are compared within the buckets that the batch touches, and only key columns
    are read of them.
    """
    spark, schema = batch.sparkSession, batch.schema
    bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
    # rows without a key differ by their place; a null never meets a key, so they stay in the one plan with the others
    place = F.when(~_keyed(keys), F.monotonically_increasing_id())
    placed = batch.withColumn(PLACE, place).withColumn(BUCKET, F.when(_keyed(keys), bucket).otherwise(F.pmod(PLACE, F.lit(buckets)).cast("int")))
    fresh, kept = placed.dropDuplicates([*keys, PLACE]).drop(PLACE), None
    checked = 0
    try:
        while True:
            entry, state = last_entry(spark, store)
            parts, last = state.get("parts", []), state.get("last", {}).get(writer)
            if last and last[0] >= number:
                return _parts(spark, store, schema, [last[1]] if last[0] == number else []).drop(BUCKET)
            if parts[checked:]:
                if kept is None and not checked:  # read twice below, and a batch may be dear to make
                    fresh = kept = fresh.persist()
                touched = [r[0] for r in fresh.select(BUCKET).distinct().collect()]  # at most the number of buckets
                held = _parts(spark, store, schema, parts[checked:]).where(F.col(BUCKET).isin(touched) & _keyed(keys)).select(BUCKET, *keys)
                fresh = fresh.join(held, [BUCKET, *keys], "left_anti").select(*batch.columns, BUCKET)
            part = f"__part={uuid.uuid4().hex}"
            fresh.repartition(BUCKET).write.partitionBy(BUCKET).parquet(f"{store}/{part}")
            if add_entry(spark, store, entry + 1, {"parts": [*parts, part], "last": state.get("last", {}) | {writer: [number, part]}}):
                return _parts(spark, store, schema, [part]).drop(BUCKET)
            # another writer came first: what this attempt wrote is the batch now, to be checked against the newer parts only
            fresh, checked = _parts(spark, store, schema, [part]), len(parts)
    finally:
        if kept is not None:
            kept.unpersist()


def compact_store(spark: SparkSession, store: str, schema) -> bool:
    """Rewrite the parts of a store as one, so that many small batches do not stay many small files; false if a batch was committed meanwhile.

    The last part of each writer stays, as its batch may be run again. Old parts stay for their readers.
    """
    entry, state = last_entry(spark, store)
    last = {part for _, part in state.get("last", {}).values()}
    old = [p for p in state.get("parts", []) if p not in last]
    if len(old) < 2:
        return True
    part = f"__part={uuid.uuid4().hex}"
    _parts(spark, store, schema, old).repartition(BUCKET).write.partitionBy(BUCKET).parquet(f"{store}/{part}")
    return add_entry(spark, store, entry + 1, state | {"parts": [part, *(p for p in state["parts"] if p in last)]})


def _writer(spark: SparkSession, checkpoint: str) -> str:
    """Id of the streaming query that owns a checkpoint."""
    return json.loads(spark.read.text(f"{checkpoint}/metadata").first().value)["id"]


def stream_once(landing: DataFrame, key: str | Sequence[str], store: str, checkpoint: str, then: Callable[[DataFrame], None] | None = None, buckets: int = BUCKETS) -> StreamingQuery:
    """Append the rows of a streaming DataFrame to the store, each key (one column or several) once; read it with :func:`read_store`.

    Repeats fall out whether they come in one micro-batch, in a later one, or from a query with
    another checkpoint. A batch is committed by one entry of the store's manifest, under the query's
    id and its number, and is added once however often it is run. ``then`` sees the new rows of each batch; it
    sees the same rows again if the query fails in it.
    """
    spark = landing.sparkSession
    keys = [key] if isinstance(key, str) else list(key)

    def add(batch: DataFrame, number: int) -> None:
        added = add_once(batch, keys, store, _writer(spark, checkpoint), number, buckets)
        if then:
            then(added)

    return landing.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def replay(rows: DataFrame, key: str | Sequence[str], max_files: int = 4) -> DataFrame:
    """``rows`` landed twice as files and taken in by :func:`stream_once`, then once more by a query of its own: the same rows, each key once."""
    spark = rows.sparkSession
    base = f"{scratch_dir(spark)}/stream-{uuid.uuid4().hex}"
    rows.write.parquet(f"{base}/landing/first")
    rows.write.parquet(f"{base}/landing/again")
    for checkpoint in ("checkpoint", "afresh"):
        landing = spark.readStream.schema(rows.schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", max_files).parquet(f"{base}/landing")
        stream_once(landing, key, f"{base}/store", f"{base}/{checkpoint}").awaitTermination()
    return read_store(spark, f"{base}/store", rows.schema)
