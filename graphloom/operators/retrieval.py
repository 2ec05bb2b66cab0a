"""Vector search, graph expansion, evidence ranking and budgeted context."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.similarity import token_set_udf
from graphloom.functions.text import canonical_key, is_generic, query_entities
from graphloom.operators.graph import touching, weighted_search
from graphloom.operators.steps import FEW, cut, small


def vector_top(vectors: DataFrame, query: list[float], k: int) -> DataFrame:
    """(id, score) of the ``k`` nearest; cosine mapped to 0..1. One scan and a top-k, no shuffle of vectors."""
    products = F.zip_with("vec", F.array(*(F.lit(float(x)) for x in query)), lambda a, b: a.cast("double") * b)
    dot = F.aggregate(products, F.lit(0.0), lambda a, x: a + x)
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (dot + 1) / 2))
    return vectors.select("id", score.alias("score")).orderBy(F.desc("score"), "id").limit(k)


#: Scores (a vector with a query each) that a task holds at a time.
AT_ONCE = 1 << 20
#: Decimals to which scores of a query set are rounded before they are ranked, so that equal vectors tie whatever block they are in.
DECIMALS = 12


def _best(scores: np.ndarray, k: int) -> np.ndarray:
    """The places of the ``k`` greatest of each row, the first of equal ones; only those that reach the row's ``k``-th are sorted."""
    if scores.shape[1] <= k:
        return np.argsort(-scores, axis=1, kind="stable")
    least = np.partition(scores, scores.shape[1] - k, axis=1)[:, -k]
    row, column = np.nonzero(scores >= least[:, None])
    order = np.lexsort((column, -scores[row, column], row))
    starts = np.searchsorted(row, np.arange(len(scores)))
    return column[order][starts[:, None] + np.arange(k)]


def scanned(vectors: DataFrame, asked: DataFrame, k: int, cells: bool = False) -> DataFrame:
    """(query_id, id, score): the ``k`` best of each query in each task, by products of blocks; ``asked`` (query_id, query) is written and few.

    With ``cells`` a query meets only the vectors whose ``cell`` is one of its ``cells``, an array.
    """
    rows = asked.collect()
    queries = np.array([r.query for r in rows], float)
    names = [r.query_id for r in rows]
    of_cell: dict[int, list[int]] = {}
    for i, r in enumerate(rows):
        for cell in r.cells if cells else [0]:
            of_cell.setdefault(cell, []).append(i)
    shared = vectors.sparkSession.sparkContext.broadcast((names, queries, {c: np.array(of) for c, of in of_cell.items()}))
    usable = vectors.where((F.size("vec") == queries.shape[1]) & F.forall("vec", lambda x: x.isNotNull()))
    usable = usable.select("id", F.col("vec").cast("array<double>").alias("vec"), (F.col("cell") if cells else F.lit(0)).cast("int").alias("cell"))
    schema = asked.select("query_id", F.lit(0.0).alias("score")).join(vectors.select("id")).select("query_id", "id", "score").schema
    whole = [f.dataType.typeName() in ("long", "integer", "short", "byte") for f in schema.fields]
    kinds = [pa.int64() if x else None for x in whole]
    kind = np.int64 if whole[1] and usable.where("id is null").isEmpty() else object

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked_for, points, of_cell = shared.value
        kept_ids = np.full((len(points), k), 0 if kind is np.int64 else None, kind)
        # Places without a hit yet have the score -1, below any.
        kept = np.full((len(points), k), -1.0)
        for batch in batches:
            every = np.array(batch.column("id").to_pylist(), kind)
            vecs, at = batch.column("vec").flatten().to_numpy().reshape(len(every), -1), batch.column("cell").to_numpy()
            for cell in np.unique(at):
                some = np.flatnonzero(at == cell)
                # Nulls come first, as Spark sorts them.
                some = some[np.argsort(every[some], kind="stable")] if kind is np.int64 else np.array(sorted(some, key=lambda i: nulls_first(every[i])), int)
                ids, matrix, wanted = every[some], vecs[some], of_cell.get(int(cell), np.zeros(0, int))
                step = max(1, AT_ONCE // len(ids))
                for start in range(0, len(wanted), step):
                    own = wanted[start : start + step]
                    block = np.round(np.fmax(0, np.fmin(1, (points[own] @ matrix.T + 1) / 2)), DECIMALS)
                    first = _best(block, k)
                    scores = np.concatenate([kept[own], np.take_along_axis(block, first, 1)], axis=1)
                    both = np.concatenate([kept_ids[own], ids[first]], axis=1)
                    rank = np.unique(both, return_inverse=True)[1].reshape(both.shape) if kind is np.int64 else ranks(both)
                    order = np.lexsort((rank, -scores), axis=1)[:, :k]
                    kept[own], kept_ids[own] = np.take_along_axis(scores, order, 1), np.take_along_axis(both, order, 1)
        row, column = np.nonzero(kept >= 0)
        if len(row):
            yield pa.RecordBatch.from_arrays([pa.array([asked_for[i] for i in row], kinds[0]), pa.array(kept_ids[row, column].tolist(), kinds[1]), pa.array(kept[row, column])], ["query_id", "id", "score"])

    def nulls_first(x: object) -> tuple:
        return x is not None, 0 if x is None else x

    def ranks(ids: np.ndarray) -> np.ndarray:
        place = {x: i for i, x in enumerate(sorted(set(ids.ravel()), key=nulls_first))}
        return np.array([place[x] for x in ids.ravel()]).reshape(ids.shape)

    casted = [F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields]
    wide = ", ".join(f"{f.name} {'bigint' if kind is not None else f.dataType.simpleString()}" for f, kind in zip(schema.fields, kinds, strict=True))
    return usable.mapInArrow(run, wide).select(*casted)


def vector_top_each(vectors: DataFrame, asked: DataFrame, k: int, names: DataFrame | None = None) -> DataFrame:
    """(query_id, id, score): the ``k`` nearest of each of the queries ``asked`` (query_id, query), by a scan of all vectors.

    Queries that are counted as few go to every task, which multiplies blocks and
    keeps ``k`` hits a query; more of them meet the vectors pair by pair. With
    ``names`` (id, name), of nodes with one canonical name only the best counts.
    Vectors that are null, have a null or another length than the queries are no
    hits. Scores are rounded to DECIMALS, ties go to the lesser id.
    """
    asked = cut(asked.select("query_id", F.col("query").cast("array<double>").alias("query")).where("query is not null"))
    sizes = [r.n for r in asked.select(F.size("query").alias("n")).distinct().limit(2).collect()]
    if len(sizes) == 1 and asked.count() <= FEW:
        scored = scanned(vectors, asked, k)
    else:
        whole = F.forall("vec", lambda x: x.isNotNull()) & (F.size("vec") == F.size("query"))
        dot = F.aggregate(F.zip_with("vec", "query", lambda a, b: a.cast("double") * b), F.lit(0.0), lambda a, x: a + x)
        scored = vectors.crossJoin(asked).where(whole).select("query_id", "id", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (dot + 1) / 2)), DECIMALS).alias("score"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    top = scored.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k)
    if names is None:
        return top.select("query_id", "id", "score")
    named = top.join(names.select("id", canonical_key(F.coalesce("name", F.lit(""))).alias("canon")), "id")
    return named.groupBy("query_id", "canon").agg(F.min_by(F.struct("id", "score"), "place").alias("b")).select("query_id", "b.id", "b.score")


def merged_seeds(*hits: DataFrame) -> DataFrame:
    """(id, score): the best score of each node over the question's and its parts' hits."""
    return reduce(DataFrame.unionByName, [h.select("id", "score") for h in hits]).groupBy("id").agg(F.max("score").alias("score"))


def reranked(hits: DataFrame, nodes: DataFrame, question: str, k: int = 3) -> DataFrame:
    """(id, exact, fuzzy): of the best six times ``k`` hits (id, score), the ``k`` nodes whose name stands in the question, then those most like it.

    The hits left to compare are at most six times ``k`` rows; ties go to the better hit.
    """
    near = hits.groupBy("id").agg(F.max("score").alias("score")).orderBy(F.desc("score"), "id").limit(6 * k)
    both = nodes.select("id", F.coalesce("name", F.lit("")).alias("name"), F.coalesce("description", F.lit("")).alias("description")).join(F.broadcast(near), "id")
    exact = F.contains(F.lit(f" {question.lower()} "), F.concat(F.lit(" "), F.lower("name"), F.lit(" "))).cast("int")
    fuzzy = token_set_udf(F.lit(question), F.concat_ws(" ", "name", "description"))
    return both.select("id", "score", exact.alias("exact"), fuzzy.alias("fuzzy")).orderBy(F.desc("exact"), F.desc("fuzzy"), F.desc("score"), "id").limit(k).drop("score")


def named_like(things: DataFrame, part: str, k: int = 20, order: str = "id") -> DataFrame:
    """The first ``k`` things, by ``order``, whose name has ``part`` in it, whatever its case: suggestions while a name is typed. One scan and a top-k."""
    return things.where(F.contains(F.lower("name"), F.lit(part.lower()))).orderBy(order).limit(k)


def ranked(things: DataFrame, edges: DataFrame, vectors: DataFrame, question: str, query: list[float], k: int = 12, hops: int = 1) -> DataFrame:
    """The ``k`` best nodes by semantic, graph, lexical and evidence score."""
    return ranked_from(things, edges, cut(vector_top(vectors, query, 2 * k)), question, k, hops)


def ranked_from(things: DataFrame, edges: DataFrame, semantic: DataFrame, question: str, k: int = 12, hops: int = 1) -> DataFrame:
    """``ranked`` from given hits (id, score). ``semantic`` is read several times; of ``edges`` each step reads those that its few nodes touch."""
    graph = weighted_search(edges, things, semantic.orderBy(F.desc("score"), "id").limit(2 * k), hops)
    both = semantic.select("id", F.col("score").alias("sem")).join(graph.select("id", F.col("score").alias("graph"), "depth"), "id", "full_outer")
    both = cut(both.na.fill({"sem": 0.0, "graph": 0.0, "depth": 0}))
    out = touching(edges, both).groupBy(F.col("subject").alias("from")).agg(F.count("*").alias("out_degree"))
    rows = things.join(small(both), "id").join(out, F.col("id") == F.col("from"), "left")
    entities = query_entities(F.lit(question))
    text = F.lower(F.concat_ws(" ", "name", "description"))
    lexical = F.sqrt(F.size(F.filter(entities, lambda e: F.contains(text, e)))) / F.greatest(F.lit(1), F.size(entities))
    evidence = F.size("source_papers") + F.coalesce("out_degree", F.lit(0))
    damp = F.when(is_generic(F.col("name")), 0.8).otherwise(1.0)
    rows = rows.select("id", "name", (F.col("sem") * damp).alias("score_sem"), (F.col("graph") * damp).alias("score_graph"), "depth", lexical.alias("lexical_overlap"), evidence.cast("long").alias("evidence_ct"))
    total = 0.8 * F.col("score_sem") + 0.6 * F.col("score_graph") / (1 + F.col("depth")) + 0.6 * F.col("lexical_overlap") + 0.3 * F.tanh(F.col("evidence_ct") / 5)
    return rows.withColumn("score_prp", total).orderBy(F.desc("score_prp"), F.desc("evidence_ct"), "id").limit(k)


def budgeted(sections: DataFrame, group: str, budget: int) -> DataFrame:
    """Sections (group, rank, section) up to the one that crosses the budget, which stays; the first always does."""
    before = Window.partitionBy(group).orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    prior = F.coalesce(F.sum(F.length("section")).over(before), F.lit(0))
    return sections.withColumn("prior", prior).where(F.col("prior") < budget)
