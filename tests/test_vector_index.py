"""The inverted-file index and the hashed encoder."""

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from graphloom.operators import encoder, retrieval, vector_index


@pytest.fixture(scope="module")
def vectors(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    return rows.select(F.concat(F.lit("v"), "vec_id").alias("id"), F.col("embedding").alias("vec"), "vec_id")


def test_recall_and_pruning(spark, vectors):
    path, probes = vector_index.indexed(vectors.select("id", "vec"), 12, 0.95)
    asked = vectors.where("vec_id % 10 = 0").select("vec_id", F.col("vec").alias("query")).withColumnRenamed("vec_id", "query_id")
    assert asked.count() == 200
    found = {(r.query_id, r.id) for r in vector_index.search(spark, path, asked, 12, probes).collect()}
    exact = {(r.query_id, r.id) for r in retrieval.vector_top_each(vectors.select("id", "vec"), asked, 12).collect()}
    assert len(found & exact) / len(exact) >= 0.9
    stored = spark.read.parquet(f"{path}/vectors")
    assert stored.count() == vectors.count() and stored.select("cell").distinct().count() > 64
    one = asked.where("query_id = 0")
    plan = vector_index.search(spark, path, one, 12, 3)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(cell" in plan or "PartitionFilters: [cell" in plan
    assert vector_index.search(spark, path, one, 12, 3).count() == 12


def test_all_cells_give_the_exact_hits(spark):
    rows = [(f"v{i}", [math.cos(i), math.sin(i), math.cos(3 * i)]) for i in range(300)] + [("none", None), ("empty", []), ("v0", [1.0, 0.0, 1.0])]
    data = spark.createDataFrame(rows, "id string, vec array<double>")
    path, _ = vector_index.indexed(data, 5)
    asked = spark.createDataFrame([(1, [0.0, 1.0, 0.5]), (2, [1.0, 0.0, 0.0])], "query_id int, query array<double>")
    usable = data.where("size(vec) = 3")
    found = sorted(map(tuple, vector_index.search(spark, path, asked, 5, 10_000).collect()))
    exact = sorted(map(tuple, retrieval.vector_top_each(usable, asked, 5).collect()))
    assert [r[:2] for r in found] == [r[:2] for r in exact]
    assert spark.read.parquet(f"{path}/vectors").count() == len(rows)
    none, probes = vector_index.indexed(data.where("false"), 5)
    assert vector_index.search(spark, none, asked, 5, probes).count() == 0


def test_cells_and_samples(spark):
    assert [vector_index.cells_for(n) for n in (0, 1024, 10_000, 10**12)] == [64, 64, 200, vector_index.MOST_CELLS]
    ids = spark.range(20_000).withColumnRenamed("id", "id")
    assert 700 < vector_index.sampled(ids, 20_000, 1000, "x").count() <= 2000 and vector_index.sampled(ids, 20_000, 30_000, "x").count() == 20_000


def test_encoder_against_python(spark):
    texts = {1: "the film is the best", 2: "a thin film", 3: "", 4: None, 5: "the film is the best", 6: "Film! FILM?"}
    rows = encoder.hashed_encoder(64)(spark.createDataFrame(list(texts.items()), "id int, text string")).collect()
    words = {i: Counter(one_place(spark, w) for w in (t or "").lower().replace("!", "").replace("?", "").split()) for i, t in texts.items()}
    spread = Counter(p for c in words.values() for p in c)
    for r in rows:
        made = {p: n * (math.log((1 + len(texts)) / (spread[p] + 1)) + 1) for p, n in words[r.id].items()}
        size = math.sqrt(sum(x * x for x in made.values())) or 1.0
        assert len(r.vec) == 64 and all(abs(x - made.get(p, 0.0) / size) < 1e-12 for p, x in enumerate(r.vec))
    assert len(rows) == len(texts)


_places: dict = {}


def one_place(spark, word):
    if word not in _places:
        _places[word] = spark.range(1).select(encoder.place_of(F.lit(word), 64)).first()[0]
    return _places[word]


def test_near_copies_are_found(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("length(text) > 200").select(F.col("doc_id").alias("id"), "text")
    planted = docs.orderBy("id").limit(5).select((F.col("id") + 1_000_000).alias("id"), F.concat(F.lit("Seen once more. "), "text").alias("text"))
    made = encoder.hashed_encoder(256)(docs.union(planted))
    asked = made.where("id >= 1000000").select(F.col("id").alias("query_id"), F.col("vec").alias("query"))
    best = retrieval.vector_top_each(made.where("id < 1000000"), asked, 3).collect()
    copies = {r.id: {x.id for x in docs.where(F.col("text") == r.text).collect()} for r in docs.orderBy("id").limit(5).collect()}
    for i, same in copies.items():
        assert same & {r.id for r in best if r.query_id == i + 1_000_000}
