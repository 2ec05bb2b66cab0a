"""Connected components of an edge table, without collecting any of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.store import Scratch


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
    return row[0], row[1]


def _least(edges: DataFrame, both_ways: bool) -> DataFrame:
    """Edges (u, v), v < u, relinked through each node's least neighbour; hot nodes meet as one row a task.

    both_ways: each node's greater neighbours are linked to the least of its
    neighbours and itself; else its lesser neighbours and itself are.
    """
    arcs = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if both_ways else edges
    least = arcs.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")).withColumnRenamed("u", "hub")
    linked = arcs.join(least, F.col("u") == F.col("hub"))
    moved = linked.where(F.col("v") > F.col("u")) if both_ways else linked.where(F.col("v") != F.col("m"))
    out = moved.select(F.col("v").alias("u"), F.col("m").alias("v"))
    if not both_ways:
        out = out.union(least.select(F.col("hub").alias("u"), F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def components(edges: DataFrame, tables: Scratch, name: str) -> DataFrame:
    """(node, component) of every node of ``edges`` (two id columns), as table ``name``; the component is its least node.

    Alternates large-star and small-star steps until nothing moves. Each step's
    edges are written to the shared folder and deleted after the next.
    """
    a, b = edges.columns
    ordered = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    now = tables.write(ordered, "star")
    before, state = None, _state(now)
    while state != before and state[0]:
        now = tables.write(_least(tables.write(_least(now, True), "large_star"), False), "star")
        before, state = state, _state(now)
    nodes = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    out = tables.write(nodes.union(now.select(F.col("v"), F.col("v")).distinct()), name)
    tables.drop("star", "large_star")
    return out
