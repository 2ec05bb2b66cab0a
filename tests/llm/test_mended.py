"""Clashing columns, hot keys beyond the bound, one-pass encoding, and the classifier's bounds and likelihood."""

import math
import random

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F

from graphloom.llm import bpe_backtrack, ordinal_classifier, quality_rules, skew

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def test_quality_keeps_columns_of_any_name(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice(["word", "other", "thing", "more"]) + str(rng.randrange(50)) for _ in range(40)), "en", "web", 7.0, "m", [1.5], 2, "t") for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, x0 double, mean string, inv array<double>, g int, text_of_ string").withColumns({c: F.lit(c) for c in ("cov", "spread", "fine", "coarse", "d2", "top", "row_of_", "has_fine")})
    got = quality_rules.judge(docs, keep_text=True)
    assert set(docs.columns) <= set(got.columns) and len(set(got.columns)) == len(got.columns)
    assert sorted(map(tuple, got.select(docs.columns).collect())) == sorted(map(tuple, docs.collect()))
    plain = {r.doc_id: (r.kept, round(r.distance, 9)) for r in quality_rules.judge(docs.select("doc_id", "text", "lang", "source")).collect()}
    assert {r.doc_id: (r.kept, round(r.distance, 9)) for r in got.collect()} == plain
    again = quality_rules.judge(docs.withColumn("kept", F.lit("old")))
    assert again.columns.count("kept") == 1 and dict(again.dtypes)["kept"] == "boolean"


def test_more_hot_keys_than_the_bound(spark, monkeypatch):
    monkeypatch.setattr(skew, "PER_TASK", 2)
    monkeypatch.setattr(skew, "MOST_KEYS", 3)
    counts = spark.createDataFrame([(f"k{i}", i) for i in range(1, 12)], "key string, n long")
    hot = skew.hot_keys(counts, "key", "n")
    assert {r.key: r.salts_ for r in hot.collect()} == {"k11": 6, "k9": 5, "k10": 5}
    left = spark.createDataFrame([(f"k{i}", j) for i in range(1, 12) for j in range(i)], "key string, j int")
    right = counts.select("key", (F.col("n") * 10).alias("ten"))
    got = skew.salted_join(left, right, "key", ["j"], hot)
    assert got.count() == left.count() and got.where("ten <> 10 * cast(substr(key, 2) as int)").count() == 0
    assert skew.hot_keys(counts.where("n < 3"), "key", "n") is None


def test_one_pass_equals_two(spark):
    texts = [None, "", "  two  spaces ", "line\nbreak", "é漢🎉 \u0000", "Repeated words of a text " * 3000]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    one = bpe_backtrack.round_trip(docs, MODEL)
    two = bpe_backtrack.decode(bpe_backtrack.encode(docs, MODEL), MODEL)
    assert one.columns == two.columns and sorted(map(tuple, one.collect()), key=str) == sorted(map(tuple, two.collect()), key=str)


def rated(spark, n, **extra):
    rows = [(i, f"good fine text {i}" if i % 2 else f"bad poor text {i}", i % 2) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, text string, grade int")


def test_features_are_bounded_by_fewer_texts(spark, monkeypatch):
    full = rated(spark, 60).withColumn("grade", F.when(F.col("doc_id") % 2 == 1, 2).otherwise(0))
    sizes = {}
    monkeypatch.setattr(ordinal_classifier, "fit_ordinal", lambda lists, grades, n: sizes.setdefault("lists", [len(x) for x in lists]))
    ordinal_classifier.fit(full, 3)
    whole = sizes.pop("lists")
    assert len(whole) == 60
    monkeypatch.setattr(ordinal_classifier, "MOST_FEATURES", sum(whole) // 2)
    ordinal_classifier.fit(full, 3)
    some = sizes.pop("lists")
    assert 20 < len(some) < 40 and sum(some) <= sum(whole) // 2 and all(n in whole for n in some)
    monkeypatch.setattr(ordinal_classifier, "MOST_RATED", 10)
    ordinal_classifier.fit(full, 3)
    assert len(sizes.pop("lists")) == 10
    ordinal_classifier.fit(full.where("false"), 3)
    assert sizes.pop("lists") == []


def test_repeated_null_and_clashing_rows(spark):
    docs = rated(spark, 40).union(spark.createDataFrame([(1000, None, 1), (1000, None, 0), (1001, "", None)], "doc_id long, text string, grade int"))
    model = ordinal_classifier.fit(docs, 2)
    given = docs.select("doc_id", "text", F.lit("k").alias("kept"), F.lit(5).alias("tail_1"), F.lit("f").alias("features"), F.lit(1).alias("order_"))
    got = ordinal_classifier.score(given, model)
    assert got.columns == ["doc_id", "text", "features", "order_", "expected_grade", "tail_1", "kept"] and got.count() == given.count()
    means = {r.odd: r.t for r in got.where("doc_id < 40").groupBy((F.col("doc_id") % 2).alias("odd")).agg(F.avg("tail_1").alias("t")).collect()}
    assert means[1] > 0.8 > 0.2 > means[0]
    assert ordinal_classifier.score(given.where("false"), model).count() == 0


def test_fit_reaches_the_likelihood_of_a_plain_search():
    rng = random.Random(3)
    lists, grades = [], []
    for _ in range(400):
        marks = [m for m in (10, 20) if rng.random() < 0.5]
        level = (1.2 if 10 in marks else 0) - (0.9 if 20 in marks else 0) + rng.gauss(0, 1.4)
        lists.append(np.array(marks, np.int32))
        grades.append(0 if level < -0.6 else 1 if level < 0.8 else 2)
    def loss(params):
        a, b, low, gap = params
        total = 0.0
        for marks, grade in zip(lists, grades, strict=True):
            score = (a if 10 in marks else 0) + (b if 20 in marks else 0)
            edges = [0.0, 1 / (1 + math.exp(score - low)), 1 / (1 + math.exp(score - low - math.exp(gap))), 1.0]
            total -= math.log(max(edges[grade + 1] - edges[grade], 1e-12))
        return total / len(lists) + ordinal_classifier.SHRINK * (abs(a) + abs(b))
    best, step = [0.0, 0.0, 0.0, 0.0], 0.5
    value = loss(best)
    while step > 1e-3:
        moved = False
        for i in range(4):
            for sign in (step, -step):
                trial = best[:i] + [best[i] + sign] + best[i + 1 :]
                if (new := loss(trial)) < value - 1e-12:
                    best, value, moved = trial, new, True
        if not moved:
            step /= 2
    model = ordinal_classifier.fit_ordinal(lists, np.array(grades), 3)
    found = [float(model.weights[10]), float(model.weights[20]), float(model.thresholds[0]), math.log(model.thresholds[1] - model.thresholds[0])]
    assert loss(found) < value + 2e-4 and max(abs(x - y) for x, y in zip(found, best, strict=True)) < 0.05
