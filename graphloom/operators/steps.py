"""Cutting the lineage of tables that an iteration reads again, and folders that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a counted table is broadcast (about 100 bytes each).
FEW = 50_000


def shared_folder(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; a folder of this machine only in local mode, where none is named."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", "") or ""
        if not named and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="graphloom-"))
    return context._jsc.sc().getCheckpointDir().get().rstrip("/")


def fresh_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """The same rows, written to the shared checkpoint folder; a folder of this machine only in local mode."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def small(table: DataFrame) -> DataFrame:
    """A written table, to be broadcast if it is counted as small."""
    return F.broadcast(table) if table.count() <= FEW else table


def files(spark: SparkSession, path: str) -> tuple:
    """The file system of a path, and the path as it knows it."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.sc().hadoopConfiguration()), target


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders right under a path; none if it doesn't exist."""
    system, target = files(spark, path)
    return [s.getPath().getName() for s in system.listStatus(target) if s.isDirectory()] if system.exists(target) else []


def delete(spark: SparkSession, path: str) -> None:
    system, target = files(spark, path)
    system.delete(target, True)
