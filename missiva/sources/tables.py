"""JSON-lines scans, append logs, versioned rewrites and CSV exports."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType

from missiva.sources.manifest import add_entry, last_entry


def _object(line: Column) -> Column:
    """The line as a JSON object; null if it is anything else."""
    return F.when(F.startswith(F.trim(line), F.lit("{")), F.try_parse_json(line))


def scan_json_lines(spark: SparkSession, path: str, schema: str, *, strict: bool = False, places: bool = False) -> DataFrame:
    """Rows of JSON-lines files. Tolerant scans skip blank, broken and non-object lines; strict ones raise on them.

    A tolerant scan keeps every object: a field of another type is cast, or null where it cannot be.
    ``places`` adds ``file_name`` and ``ordinal``, which grows with the line within a file.
    """
    if strict:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    rows = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file_name"), F.monotonically_increasing_id().alias("ordinal"))
    rows = rows.withColumn("__v", _object(F.col("value"))).where("__v is not null")
    fields = spark.createDataFrame([], schema).schema.fields
    nested = (ArrayType, MapType, StructType)
    read = lambda f: F.from_json("value", StructType([f]))[f.name] if isinstance(f.dataType, nested) else F.try_variant_get("__v", f"$['{f.name}']", f.dataType.simpleString())
    return rows.select(*(read(f).alias(f.name) for f in fields), *(["file_name", "ordinal"] if places else []))


def rejected_lines(spark: SparkSession, path: str) -> DataFrame:
    """The lines that a tolerant scan skips, as text, but for blank ones."""
    return spark.read.text(path).where((F.trim("value") != "") & _object(F.col("value")).isNull()).select("value")


def append(df: DataFrame, path: str) -> None:
    """Add rows to a log, with ``ts`` and ``ordinal`` unless they have them; readers take the last row of a key by these (see operators.archive.latest)."""
    stamped = df if "ts" in df.columns else df.withColumn("ts", F.current_timestamp())
    stamped = stamped if "ordinal" in df.columns else stamped.withColumn("ordinal", F.monotonically_increasing_id())
    stamped.write.mode("append").parquet(path)


class Outdated(RuntimeError):
    """Another writer has named a newer version meanwhile."""


def write_version(df: DataFrame, root: str, based_on: int | None = None) -> str:
    """Write a whole new version beside the old ones and name it as the current one.

    With ``based_on``, the number of the version that ``df`` was made from (see :func:`version_number`),
    a newer version of another writer raises :class:`Outdated`; without, the version comes after it.
    Old versions stay for their readers.
    """
    spark = df.sparkSession
    version = f"v-{uuid.uuid4().hex}"
    df.write.parquet(f"{root}/{version}")
    while True:
        number, _ = last_entry(spark, root)
        if based_on is not None and number != based_on:
            raise Outdated(f"{root}: version {number} came after {based_on}")
        if add_entry(spark, root, number + 1, {"version": version}):
            return f"{root}/{version}"


def version_number(spark: SparkSession, root: str) -> int:
    """Number of the current version; 0 where there is none."""
    return last_entry(spark, root)[0]


def read_version(spark: SparkSession, root: str) -> DataFrame:
    """The current version."""
    state = last_entry(spark, root)[1]
    if not state:
        raise ValueError(f"no version at {root}")
    return spark.read.parquet(f"{root.rstrip('/')}/{state['version']}")


def change_version(spark: SparkSession, root: str, change: Callable[[DataFrame], DataFrame], tries: int = 10) -> str:
    """Replace the current version by ``change`` of it; done anew on what another writer has made of it meanwhile."""
    for _ in range(tries):
        number = version_number(spark, root)
        try:
            return write_version(change(read_version(spark, root)), root, number)
        except Outdated:
            continue
    raise Outdated(f"{root}: {tries} tries")


def export_csv(df: DataFrame, path: str, columns: list[str]) -> None:
    """CSV with a header line in each part."""
    df.select(*columns).write.option("header", True).csv(path)
