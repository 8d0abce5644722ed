"""Numbered manifests: a table's state is the last entry of a log to which writers add one at a time.

Entry ``n + 1`` is created only if it is not there, so of two writers that both start from ``n`` one
wins and the other learns of it. Readers take the largest number; no clock decides anything. Every
entry holds the whole state as JSON, and states stay small, since they name folders and not rows.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession

LOG, DIGITS = "_manifest", 20


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _files(spark: SparkSession, path: str):
    return _path(spark, path).getFileSystem(spark._jsc.hadoopConfiguration())


def last_entry(spark: SparkSession, root: str) -> tuple[int, dict]:
    """Number and state of the last entry; 0 and an empty state where there is none."""
    fs, log = _files(spark, root), _path(spark, f"{root}/{LOG}")
    names = sorted(s.getPath().getName() for s in fs.listStatus(log)) if fs.exists(log) else []
    names = [n for n in names if n.isdigit()]
    if not names:
        return 0, {}
    stream = fs.open(_path(spark, f"{root}/{LOG}/{names[-1]}"))
    try:
        return int(names[-1]), json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def add_entry(spark: SparkSession, root: str, number: int, state: dict) -> bool:
    """Create entry ``number``; false, and nothing changed, if another writer has.

    The state is written aside and moved to its name by a rename that does not overwrite, which is
    atomic on HDFS and on local disks; a store whose renames are copies needs a lock of its own.
    """
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    fs = _files(spark, root)
    aside, name = _path(spark, f"{root}/{LOG}/.{uuid.uuid4().hex}"), _path(spark, f"{root}/{LOG}/{number:0{DIGITS}d}")
    if fs.exists(name):
        return False
    stream = fs.create(aside, True)
    stream.write(json.dumps(state).encode("utf-8"))
    stream.close()
    rename = jvm.org.apache.hadoop.fs.Options.Rename
    options = spark.sparkContext._gateway.new_array(rename, 1)
    options[0] = rename.NONE
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(name.toUri(), conf).rename(fs.makeQualified(aside), fs.makeQualified(name), options)
        return True
    except Exception as e:
        fs.delete(aside, False)
        if "FileAlreadyExistsException" in str(e):
            return False
        raise
