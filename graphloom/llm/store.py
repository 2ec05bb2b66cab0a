"""Tables that cut lineage: written once in the folder that all executors share, deleted when nothing needs them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Spark's setting that deletes a query's shuffle files when the query ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; a folder of this machine only in local mode, where none is named."""
    found = spark.conf.get("spark.checkpoint.dir", "") or ""
    if not found:
        context = spark.sparkContext
        made = context._jsc.sc().getCheckpointDir()
        if made.isEmpty():
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            context.setCheckpointDir(tempfile.mkdtemp(prefix="graphloom-"))
            made = context._jsc.sc().getCheckpointDir()
        found = made.get()
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """The same rows, read back from Parquet; a lost executor costs no recomputation, and no shuffle file is left."""
    spark = df.sparkSession
    path = path or fresh_path(spark, name)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.sc().hadoopConfiguration()).delete(target, True)


class Scratch:
    """Named tables of one run; a name that is written again replaces its table, and leaving the block deletes all."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = fresh_path(self.spark, name)
        out = written(df, name, path)
        self.drop(name)
        self.paths[name] = path
        return out

    def drop(self, *names: str) -> None:
        for name in names:
            if name in self.paths:
                delete(self.spark, self.paths.pop(name))

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        self.drop(*list(self.paths))
