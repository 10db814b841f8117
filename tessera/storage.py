"""Intermediate tables in the folder that the whole cluster shares.

A frame that several steps read is written once as Parquet and read again, which cuts its lineage
and survives lost executors.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []


def folder(spark: SparkSession) -> str:
    """What spark.checkpoint.dir names, or the context's checkpoint folder; a temporary folder only
    where driver and executors are one process."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    given = spark.sparkContext._jsc.sc().getCheckpointDir()
    if given.isDefined():
        return given.get().rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="tessera-"))
    return _own[0]


def write(frame: DataFrame) -> str:
    path = f"{folder(frame.sparkSession)}/tessera-{uuid.uuid4().hex}"
    frame.write.parquet(path)
    return path


def read(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def keep(frame: DataFrame) -> DataFrame:
    """The frame's rows from a table of their own; it stays as long as the folder does."""
    return read(frame.sparkSession, write(frame), frame.schema)


def remove(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
