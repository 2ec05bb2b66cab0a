"""Runs over growing sets of papers: buckets, cumulative checkpoints and what run names say."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.operators.steps import FEW, cut

#: Papers a bucket, and families of models by a part of a run's name, in the order in which they are tried.
BUCKET = 25
FAMILIES = [("deepseek", "DeepSeek-R1-"), ("qwen", "Qwen-3-235B"), ("gpt-oss", "GPT-OSS-")]


def bucketed(papers: DataFrame, size: int = BUCKET, most: int | None = None) -> DataFrame:
    """(paper, bucket): papers in order of their names, ``size`` a bucket, named by its end; only the first ``most`` if asked.

    Names are ranked within ranges that a sort makes, so no task holds them all.
    """
    ranged = papers.select("paper").distinct().repartitionByRange("paper").select("paper", F.spark_partition_id().alias("part"))
    ranged = ranged.transform(cut)
    counts = ranged.groupBy("part").count().select(F.col("part").alias("p"), (F.sum("count").over(Window.orderBy("part")) - F.col("count")).alias("before"))
    place = F.row_number().over(Window.partitionBy("part").orderBy("paper"))
    placed = ranged.withColumn("place", place).join(F.broadcast(counts), F.col("part") == F.col("p")).select("paper", (F.col("place") + F.col("before")).alias("n"))
    chosen = placed if most is None else placed.where(F.col("n") <= most)
    return chosen.select("paper", (F.ceil(F.col("n") / size) * size).cast("long").alias("bucket"))


def cumulative(rows: DataFrame, bucket: str = "bucket") -> DataFrame:
    """``rows`` once for each checkpoint that has them: their own bucket's and every later one."""
    ends = rows.select(F.col(bucket).alias("checkpoint")).distinct()
    return rows.join(F.broadcast(ends) if ends.count() <= FEW else ends, F.col(bucket) <= F.col("checkpoint"))


def first_seen(rows: DataFrame, keys: list[str], bucket: str = "bucket") -> DataFrame:
    """(keys, first): the earliest bucket of each key, by one aggregation that starts in the tasks."""
    return rows.groupBy(*keys).agg(F.min(bucket).alias("first"))


def running_counts(rows: DataFrame, keys: list[str], bucket: str = "bucket") -> DataFrame:
    """(checkpoint, keys, rows): how many different keys and rows each checkpoint has with all earlier ones.

    A key counts from the bucket that has it first, so rows aren't repeated for
    each checkpoint; only the few rows that are left, one a bucket, are added up.
    """
    new = first_seen(rows, keys, bucket).groupBy(F.col("first").alias("b")).agg(F.count("*").alias("new"))
    own = rows.groupBy(F.col(bucket).alias("checkpoint")).agg(F.count("*").alias("own"))
    up_to = Window.orderBy("checkpoint").rowsBetween(Window.unboundedPreceding, 0)
    both = own.join(new, F.col("checkpoint") == F.col("b"), "left")
    return both.select("checkpoint", F.sum(F.coalesce("new", F.lit(0))).over(up_to).alias("keys"), F.sum("own").over(up_to).alias("rows"))


class CheckpointTable:
    """Rows under ``path``, one partition a checkpoint; what a checkpoint has is its own rows and those of all before it.

    Nothing is copied forward: a checkpoint that is written again replaces its
    own files and no others, and every later state follows it.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str]):
        self.spark, self.path, self.keys = spark, path, keys

    def save(self, rows: DataFrame) -> None:
        """Writes the checkpoints that ``rows`` (with a column ``checkpoint``) have, each whole."""
        rows.hint("rebalance", "checkpoint").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("checkpoint").parquet(self.path)

    def own(self) -> DataFrame:
        return self.spark.read.parquet(self.path)

    def state(self, checkpoint: int) -> DataFrame:
        """One row a key with ``first_checkpoint``: those that a checkpoint has, from the partitions up to it."""
        rows = self.own().where(F.col("checkpoint") <= checkpoint)
        rest = [c for c in rows.columns if c not in (*self.keys, "checkpoint")]
        held = rows.groupBy(*self.keys).agg(F.min(F.struct("checkpoint", *rest)).alias("f"))
        return held.select(*self.keys, F.col("f.checkpoint").alias("first_checkpoint"), *(f"f.{c}" for c in rest))

    def counts(self) -> DataFrame:
        return running_counts(self.own(), self.keys, "checkpoint")


def last_run(runs: DataFrame) -> DataFrame:
    """The row of each model's largest run."""
    order = Window.partitionBy("model").orderBy(F.desc("papers"))
    return runs.withColumn("n_", F.row_number().over(order)).where("n_ = 1").drop("n_")


def run_of(name: Column) -> Column:
    """(model, papers) of a graph's file name, parts apart by underscores; nulls for other families, which comparisons leave out."""
    part = lambda i: F.get(F.split(F.regexp_replace(name, r"\.json$", ""), "_"), F.lit(i))
    number = lambda i: F.regexp_extract(part(i), r"^\d+", 0).cast("int")
    model, papers = F.lit(None).cast("string"), F.lit(None).cast("int")
    for family, title in reversed(FAMILIES):
        named = F.lit(title) if family == "qwen" else F.concat(F.lit(title), F.upper(part(2)))
        here = F.contains(name, F.lit(family))
        model, papers = F.when(here, named).otherwise(model), F.when(here, number(3)).otherwise(papers)
    return F.struct(model.alias("model"), papers.alias("papers"))
