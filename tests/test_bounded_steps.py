"""Steps that get no more rows than their results need."""

import numpy as np
from pyspark.sql import functions as F

from graphloom.operators import context, inference, retrieval


def test_sections_are_made_of_ranks_that_can_stay(spark, monkeypatch):
    ranked = spark.range(3000).select((F.col("id") % 2).alias("question_id"), F.col("id").alias("rank"), F.concat(F.lit("n"), "id").alias("id"), F.when(F.col("id") > 3, F.lit("name")).alias("name"), F.lit("c").alias("category"), F.lit(0.5).alias("score_prp"), F.lit("").alias("description"), F.lit(None).cast("string").alias("formula"), F.array(F.lit("p")).alias("source_papers"))
    edges = spark.range(1000, 3000).select(F.concat(F.lit("n"), "id").alias("subject"), F.lit("r:has").alias("predicate"), F.concat(F.lit("n"), F.col("id") % 7).alias("object"))
    names = ranked.select("id", "name")
    papers = spark.createDataFrame([("p", "text")], "paper string, text string")
    plain, seen = context.sections, []

    def counted(some, *rest):
        seen.append(some.count())
        return plain(some, *rest)

    monkeypatch.setattr(context, "sections", counted)
    got = {r.question_id: r.context for r in context.assembled(ranked, edges, names, papers, [], 400).collect()}
    assert seen == [2 * 26] and len(got) == 2
    for question, text in got.items():
        facts = text.split("\n\n")[0].split("\n")[1:]
        assert facts == [f"(name) -[has]-> ({'name' if i % 7 > 3 else f'n{i % 7}'})" for i in range(1000 + question, 1300, 2)][:150]
        assert text.split("\n\n")[1] == "Combined_Score: 0.500\n[PDF p]\ntext"


def test_places_of_the_best():
    scores = np.array([[0.5, 0.9, 0.9, 0.1, 0.9], [0.2, 0.2, 0.2, 0.2, 0.2], [0.1, 0.2, 0.3, 0.4, 0.5]])
    assert retrieval._best(scores, 2).tolist() == [[1, 2], [0, 1], [4, 3]]
    assert retrieval._best(scores[:, :2], 3).tolist() == [[1, 0], [0, 1], [1, 0]]


def test_scan_of_queries_own_cells(spark):
    vectors = spark.createDataFrame([(None, [1.0, 0.0], 0), (4, [1.0, 0.0], 0), (2, [1.0, 0.0], 1), (1, [0.0, 1.0], 1), (7, [float("nan"), 0.0], 2), (8, [1.0], 0)], "id long, vec array<double>, cell int").coalesce(1)
    asked = spark.createDataFrame([(1, [1.0, 0.0], [0, 1]), (2, [0.0, 1.0], [1]), (3, [1.0, 0.0], [9])], "query_id long, query array<double>, cells array<int>")
    got = [tuple(r) for r in retrieval.scanned(vectors, asked, 2, cells=True).orderBy("query_id", F.desc("score"), "id").collect()]
    assert got == [(1, None, 1.0), (1, 2, 1.0), (2, 1, 1.0), (2, 2, 0.5)]


def test_facts_of_a_busy_node_are_dealt(spark, monkeypatch):
    monkeypatch.setattr(inference, "PER_TASK", 5)
    left = [(f"a{i}", "p", "hub") for i in range(23)] + [("x", "p", "y"), ("x", "q", "hub")]
    right = [("hub", "p", f"b{i}") for i in range(12)] + [("y", "p", "z"), ("y", "q", "w")]
    rows = lambda given: spark.createDataFrame(given, "s string, p string, o string")
    got = sorted(map(tuple, inference.chained(rows(left), rows(right)).collect()))
    assert got == sorted((s, p, e) for s, p, o in left for v, q, e in right if (o, p) == (v, q))
