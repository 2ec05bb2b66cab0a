"""The similarity join against all pairs, and what uses it."""

import random

from pyspark.sql import functions as F

from graphloom.functions import similarity
from graphloom.operators import similar, terms


def table(spark, names):
    return spark.createDataFrame([(n,) for n in names], "name string")


def pairs(spark, left, right, least, measure, strict=False):
    return {(r.left, r.right) for r in similar.similar(table(spark, left), table(spark, right), least, measure, strict).collect()}


def edited(rng, word):
    letters = list(word)
    for _ in range(rng.randint(0, 3)):
        at, kind = rng.randrange(len(letters) + 1), rng.random()
        if kind < 0.4:
            letters.insert(at, rng.choice("abcxyz é"))
        elif kind < 0.8 and letters:
            letters.pop(min(at, len(letters) - 1))
        elif letters:
            letters[0] = rng.choice("qrst")
    return "".join(letters)


def test_equal_to_all_pairs_on_random_strings(spark):
    rng = random.Random(5)
    words = ["".join(rng.choice("abcd e") for _ in range(rng.randint(1, 24))) for _ in range(150)]
    left, right = [edited(rng, w) for w in words] + ["", "a", "ab", "aab", "aaaa", "zz"], words + ["b", "ab", "abb", "aaaaa", "", "zzz"]
    for least, measure, strict in ((0.8, "ratio", False), (0.85, "sequence", True), (0.6, "ratio", False)):
        score = (lambda a, b: similarity.ratio(a, b) / 100) if measure == "ratio" else similarity.sequence_ratio
        wanted = {(a, b) for a in set(left) for b in set(right) if a and b and (score(a, b) > least if strict else score(a, b) >= least)}
        assert pairs(spark, left, right, least, measure, strict) == wanted and len(wanted) > 60


def test_equal_to_all_pairs_on_part_names(spark):
    names = [r[0] for r in spark.read.parquet("/root/testdata/sf0.001/part.parquet").select(F.lower("p_name")).distinct().collect()]
    wanted = {(a, b) for a in names for b in names if similarity.ratio(a, b) >= 80}
    assert pairs(spark, names, names, 0.8, "ratio") == wanted


def test_hot_grams_and_hard_rows(spark, monkeypatch):
    monkeypatch.setattr(similar, "COMMON", 2)
    names = [f"supplier number {i:03d}" for i in range(60)]
    wanted = {(a, b) for a in names for b in names if similarity.ratio(a, b) >= 95}
    assert pairs(spark, names, names, 0.95, "ratio") == wanted
    assert pairs(spark, [None, "", "x"], ["x", None, "x"], 0.8, "ratio") == {("x", "x")}
    assert pairs(spark, [], ["x"], 0.8, "ratio") == set() == pairs(spark, ["x"], [], 0.8, "sequence")
    long = "abcdefghij" * 500
    assert pairs(spark, [long + "x"], ["y" + long], 0.99, "ratio") == {(long + "x", "y" + long)}


def test_first_like_has_no_first_letter(spark):
    known = spark.createDataFrame([("polymer blend film", 3), ("zinc", 1)], "name string, ordinal long")
    got = terms.first_like(table(spark, ["apolymer blend film", "inc", "tin"]).withColumnRenamed("name", "term"), known)
    assert {r.term: r.match for r in got.collect()} == {"apolymer blend film": "polymer blend film", "inc": "zinc"}
