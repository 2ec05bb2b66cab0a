"""A dictionary of terms that grows by batches: mentions and records in hash buckets, of which a batch rewrites those that it touches.

A bucket holds all mentions of its terms, so its records are made from it alone.
Each batch writes the touched buckets as a version of its own, mentions first;
readers take the last version of every bucket of which the records are complete.
A batch that fails leaves a version that isn't, which nobody reads and the next
write replaces, and a batch that is replayed finds its mentions known, by their
ordinals, and writes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from graphloom.operators.steps import delete, files, folders
from graphloom.operators.terms import keyed, records

#: The least number of digits of a version, so that names sort as numbers do.
DIGITS = 12


class TermStore:
    """Mentions and records of terms under ``path``; ``buckets`` is fixed when the store is made."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    def versions(self, table: str) -> dict[int, str]:
        """The version that holds each bucket: the last complete one. Names of folders are read, never rows."""
        found: dict[int, str] = {}
        for version in self.complete():
            found |= {int(b.split("=")[1]): version for b in folders(self.spark, f"{self.path}/{table}/{version}") if b.startswith("bucket=")}
        return found

    def read(self, table: str, buckets: list[int] | None = None) -> DataFrame | None:
        """The rows of a table (``mentions`` or ``records``), or of some of its buckets; None if there are none."""
        held = {b: v for b, v in self.versions(table).items() if buckets is None or b in buckets}
        paths = [f"{self.path}/{table}/{v}/bucket={b}" for b, v in sorted(held.items())]
        return self.spark.read.option("basePath", f"{self.path}/{table}").parquet(*paths).drop("version") if paths else None

    def complete(self) -> list[str]:
        """The versions whose records are written whole, in order."""
        every = []
        for version in sorted(folders(self.spark, f"{self.path}/records")):
            system, done = files(self.spark, f"{self.path}/records/{version}/_SUCCESS")
            if system.exists(done):
                every.append(version)
        return every

    def upsert(self, batch: DataFrame) -> list[int]:
        """Adds the mentions of a batch and returns the buckets that were rewritten. Mentions are known by their ordinals."""
        bucket = F.pmod(F.xxhash64("key"), F.lit(self.buckets)).cast("int")
        new = keyed(batch).withColumn("bucket", bucket).dropDuplicates(["ordinal"])
        # At most as many as the store has buckets.
        touched = sorted(r.bucket for r in new.select("bucket").distinct().collect())
        old = self.read("mentions", touched)
        if old is not None:
            new = new.join(old.select(F.col("ordinal").alias("known"), F.col("bucket").alias("known_bucket")), (F.col("ordinal") == F.col("known")) & (F.col("bucket") == F.col("known_bucket")), "left_anti")
            touched = sorted(r.bucket for r in new.select("bucket").distinct().collect())
            kept = self.read("mentions", touched)
            new = new if kept is None else kept.unionByName(new.where(F.col("bucket").isin(touched)), allowMissingColumns=True)
        if not touched:
            return []
        last = self.complete()[-1:]
        version = f"version={int(last[0].split('=')[1]) + 1 if last else 0:0{DIGITS}d}"
        self._write(new, "mentions", version)
        whole = self.spark.read.parquet(f"{self.path}/mentions/{version}")
        self._write(records(whole.drop("bucket")).withColumn("bucket", bucket), "records", version)
        return touched

    def _write(self, rows: DataFrame, table: str, version: str) -> None:
        rows.hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/{table}/{version}")

    def mentions(self) -> DataFrame | None:
        return self.read("mentions")

    def records(self) -> DataFrame | None:
        """The dictionary as it is; no merging is left to the reader."""
        found = self.read("records")
        return None if found is None else found.drop("bucket")

    def vacuum(self) -> list[str]:
        """Deletes versions that hold no bucket any more, of both tables; not to be called while a batch is written."""
        gone = []
        for table in ("mentions", "records"):
            held = set(self.versions(table).values())
            for version in folders(self.spark, f"{self.path}/{table}"):
                if version.startswith("version=") and version not in held:
                    delete(self.spark, f"{self.path}/{table}/{version}")
                    gone.append(f"{table}/{version}")
        return sorted(gone)


def follow(mentions: DataFrame, path: str, checkpoint: str, buckets: int = 64) -> StreamingQuery:
    """Upsert what has arrived into the store under ``path``, and stop."""
    store = TermStore(mentions.sparkSession, path, buckets)
    return mentions.writeStream.foreachBatch(lambda batch, _: store.upsert(batch) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def terms(spark: SparkSession, path: str) -> DataFrame:
    """The dictionary's terms with the columns of ``merge_mentions``, as they are stored."""
    found = TermStore(spark, path).records()
    if found is None:
        raise ValueError(f"no batch was written to {path}")
    return found.select("key", "term", "category", "definition", "pages", "source_papers", "importance")
