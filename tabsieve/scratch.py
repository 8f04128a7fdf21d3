"""Where intermediate data go: a folder that the driver and all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession

_own_dir: str | None = None
_made: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or in local mode, where it is not set, a temporary folder of our own."""
    global _own_dir
    if told := spark.conf.get("spark.checkpoint.dir", None):
        return told.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    _own_dir = _own_dir or f"file://{tempfile.mkdtemp(prefix='tabsieve-')}"
    return _own_dir


def new_path(spark: SparkSession, name: str) -> str:
    _made.append(f"{shared_dir(spark)}/tabsieve-{name}-{uuid.uuid4().hex}")
    return _made[-1]


def clean_up(spark: SparkSession) -> int:
    """Delete the folders that new_path has named in this process; returns how many there were. DataFrames that read them
    can't be used afterwards."""
    jvm, gone = spark.sparkContext._jvm, 0
    while _made:
        path = jvm.org.apache.hadoop.fs.Path(_made.pop())
        gone += path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    return gone
