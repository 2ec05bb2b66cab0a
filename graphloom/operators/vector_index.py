"""An inverted-file index of vectors: cells of a k-means, one partition of a table each.

Cells are trained on a bounded sample, every vector is assigned to its nearest
cell, and a search reads the partitions of each query's nearest cells only. How
many those are is measured: the least number at which the wanted share of a
sample of exact hits is found. The exact way is ``retrieval.vector_top_each``,
which scans all vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, isqrt

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.operators.retrieval import DECIMALS, scanned, vector_top_each
from graphloom.operators.steps import FEW, cut, fresh_folder, small

#: Fixed values of the number of cells: 64 at least, else twice the root of the number of vectors.
LEAST_CELLS, PER_ROOT = 64, 2
#: Most cells, since the driver and each task hold their centres; vectors a cell in the training sample; queries in the sample that is measured.
MOST_CELLS, TRAINED_ON, MEASURED = 16_384, 64, 200


def cells_for(rows: int) -> int:
    return min(max(LEAST_CELLS, isqrt(PER_ROOT * PER_ROOT * rows)), MOST_CELLS)


def sampled(rows: DataFrame, total: int, wanted: int, salt: str) -> DataFrame:
    """About ``wanted`` of ``total`` rows (twice that at most), chosen by hashes of their ids, so that a retry takes the same ones."""
    if total <= wanted:
        return rows
    share = int(wanted / total * (1 << 40)) + 1
    return rows.where(F.pmod(F.xxhash64(F.lit(salt), "id"), F.lit(1 << 40)) < share).limit(2 * wanted)


def build(vectors: DataFrame, path: str, cells: int | None = None, seed: int = 7) -> int:
    """Writes the index of ``vectors`` (id, vec) and returns the number of its cells.

    Every row is written; those without a vector get cell -1, which no search
    reads. Large cells are split over tasks and files as Spark rebalances them.
    """
    spark = vectors.sparkSession
    whole = F.col("vec").isNotNull() & F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x))
    usable = vectors.where(whole & (F.size("vec") > 0))
    total = usable.count()
    wanted = min(cells or cells_for(total), MOST_CELLS, max(total, 1))
    centres = np.zeros((0, 0))
    point = array_to_vector(F.col("vec").cast("array<double>"))
    rest = vectors.where(~(whole & (F.size("vec") > 0)) | F.col("vec").isNull()).withColumn("cell", F.lit(-1))
    placed = rest
    if total:
        train = cut(sampled(usable, total, wanted * TRAINED_ON, "train").select(point.alias("point")))
        model = KMeans(k=wanted, seed=seed, maxIter=10, featuresCol="point", predictionCol="cell").fit(train)
        centres = np.array(model.clusterCenters())
        placed = model.transform(usable.withColumn("point", point)).drop("point").unionByName(rest)
    placed.hint("rebalance", "cell").write.partitionBy("cell").mode("overwrite").parquet(f"{path}/vectors")
    # The columns, which a table without partitions doesn't tell.
    vectors.where("false").coalesce(1).write.mode("overwrite").parquet(f"{path}/shape")
    rows = [(i, [float(x) for x in c]) for i, c in enumerate(centres)]
    spark.createDataFrame(rows, "cell int, centre array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/centres")
    return len(centres)


def stored(spark: SparkSession, path: str) -> DataFrame:
    """The index's rows with their ``cell``."""
    return spark.read.schema(spark.read.parquet(f"{path}/shape").schema.add("cell", "integer")).parquet(f"{path}/vectors")


def cell_order(spark: SparkSession, path: str, asked: DataFrame, first: int | None = None) -> DataFrame:
    """(query_id, query, place, cell): each query's cells, nearest first, or the ``first`` of them."""
    centres = np.array([r.centre for r in spark.read.parquet(f"{path}/centres").orderBy("cell").collect()])
    shared = spark.sparkContext.broadcast(centres)
    key = asked.schema["query_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = shared.value
        for batch in batches:
            if not len(known):
                continue
            points = np.array([np.asarray(q, float) for q in batch["query"]]).reshape(len(batch), -1)
            near = np.argsort((known**2).sum(axis=1) - 2 * points @ known.T, axis=1, kind="stable")[:, :first]
            yield pd.DataFrame({"query_id": batch["query_id"], "query": batch["query"], "cells": [row.astype(np.int32) for row in near]})

    found = asked.select("query_id", F.col("query").cast("array<double>").alias("query")).where("query is not null")
    found = found.mapInPandas(run, f"query_id {key}, query array<double>, cells array<int>")
    return found.select("query_id", "query", F.posexplode("cells").alias("place", "cell"))


def search(spark: SparkSession, path: str, asked: DataFrame, k: int, probes: int) -> DataFrame:
    """(query_id, id, score): the ``k`` best of each of the queries ``asked`` (query_id, query) among the vectors of its ``probes`` nearest cells.

    The cells that any query asks for are known before the scan, so only their
    partitions are read.
    """
    wanted = cut(cell_order(spark, path, asked, probes))
    cells = [r.cell for r in wanted.select("cell").distinct().collect()]
    vectors = stored(spark, path).where(F.col("cell").isin(cells))
    # A query each, which go to every task; more of them meet the vectors of their cells pair by pair.
    each = cut(wanted.groupBy("query_id", "query").agg(F.collect_list("cell").alias("cells")))
    if cells and each.count() <= FEW:
        scored = scanned(vectors, each, k, cells=True)
    else:
        dot = F.aggregate(F.zip_with("vec", "query", lambda a, b: a.cast("double") * b), F.lit(0.0), lambda a, x: a + x)
        scored = vectors.join(small(wanted), "cell").select("query_id", "id", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (dot + 1) / 2)), DECIMALS).alias("score"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return scored.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k).drop("n")


def probes_for(spark: SparkSession, path: str, k: int, recall: float) -> int:
    """The least number of cells that holds a ``recall`` share of the exact ``k`` nearest of MEASURED of the index's own vectors."""
    every = stored(spark, path).where("cell >= 0")
    asked = cut(sampled(every, every.count(), MEASURED, "measure").select(F.col("id").alias("query_id"), F.col("vec").cast("array<double>").alias("query")))
    exact = cut(vector_top_each(every, asked, k))
    at = every.select("id", "cell").join(small(exact), "id")
    places = cell_order(spark, path, asked).select("query_id", "cell", "place")
    row = at.join(places, ["query_id", "cell"]).agg(F.percentile("place", F.lit(recall)).alias("place"), F.count("*").alias("n")).first()
    return ceil(row.place) + 1 if row.n else 1


def indexed(vectors: DataFrame, k: int, recall: float = 0.95, cells: int | None = None) -> tuple[str, int]:
    """(path, probes) of an index in the shared folder that finds a ``recall`` share of exact hits."""
    spark = vectors.sparkSession
    path = fresh_folder(spark, "vector-index")
    build(vectors, path, cells)
    return path, probes_for(spark, path, k, recall)
