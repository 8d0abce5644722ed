"""Session settings and shared scratch tables."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def get_spark(app: str = "missiva", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the settings the operators assume: UTC, AQE with skew-join splitting."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    for key, value in (base | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a single-process session (tests, notebooks) may go without that setting; it gets a
    temporary folder of its own. On a cluster a missing setting is an error, since a local
    folder would be lost with its executor.
    """
    known = spark.conf.get("spark.checkpoint.dir", None)
    if known:
        return known.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = getattr(spark, "_missiva_scratch", None)
    if made is None:
        made = spark._missiva_scratch = "file://" + tempfile.mkdtemp(prefix="spark-")
    return made


def small_batches(spark: SparkSession, size: str = "8m") -> None:
    """Bound the bytes of the Arrow batches that Python workers get, unless the session sets a bound: rows may be long texts."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, "67108864b") == "67108864b":
        spark.conf.set(key, size)


def lean(run: Callable, *forget: Callable[[], None]) -> Callable:
    """``run`` for ``mapInArrow``; at the end of each task ``forget`` drops what it has remembered, and freed memory goes back to the system.

    Workers stay for a minute beside the executor, and other operators run in them; what they kept
    from their last task would count with the memory of the next stage.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            for f in forget:
                f()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU library only
            if trim:
                trim(0)

    return task


_HELD: dict[object, object] = {}


def held(key: object, make: Callable[[], object]):
    """A value that a worker keeps over its tasks; only one at a time, that of another key is dropped."""
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = make()
    return _HELD[key]


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Cut lineage: write ``df`` once as Parquet under the shared scratch folder and reread it.

    The shuffle files of the writing query are dropped as soon as it ends, since the table replaces
    them; otherwise the files of every step would pile up until the driver collects its garbage.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    before = spark.conf.get(DROP_SHUFFLES, "false")
    spark.conf.set(DROP_SHUFFLES, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(DROP_SHUFFLES, before)
    return spark.read.schema(df.schema).parquet(path)


def sized(df: DataFrame, rows: int, per_partition: int = 250_000) -> DataFrame:
    """``df`` in as many partitions as its known number of rows asks for, and not more than it has.

    Small steps of an iteration then neither run nor leave a file for every shuffle partition.
    """
    return df.coalesce(max(1, -(-rows // per_partition)))


def spread(df: DataFrame, *keys: str, per_partition: int = 50_000) -> DataFrame:
    """``df`` in partitions of about so many rows, dealt by ``keys``, for work that takes long for each row.

    Each row group of a file is read by one task, however many rows it holds and however many cores wait.
    """
    return df.repartition(max(1, -(-df.count() // per_partition)), *keys)
