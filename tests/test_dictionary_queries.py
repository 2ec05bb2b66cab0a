"""Each registered query of dictionaries, similarity and inference against its SQL, on the smallest tables; the index against the exact scan."""

import pytest

from graphloom.functions import similarity
from graphloom.plans import dictionary
from tests.test_reference_queries import SF, duck, plain  # noqa: F401

WITHOUT_SQL = {"vector_index_top", "first_like_names"}


def test_every_query_has_sql_or_a_test():
    assert set(dictionary.QUERIES) - set(dictionary.ORACLE_SQL) == WITHOUT_SQL


@pytest.mark.parametrize("name", dictionary.ORACLE_SQL)
def test_same_rows(spark, duck, name):  # noqa: F811
    df = dictionary.QUERIES[name](spark, SF)
    want = duck.execute(dictionary.ORACLE_SQL[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(df.columns)
    assert plain([tuple(r) for r in df.collect()], df.columns) == plain(want.fetchall(), columns)


def test_index_against_the_scan(spark):
    found = {(r.query_id, r.id) for r in dictionary.vector_index_top(spark, "/root/testdata/sf0.01").collect()}
    exact = {(r.query_id, r.id) for r in dictionary.vector_top_many(spark, "/root/testdata/sf0.01").collect()}
    assert len(found & exact) / len(exact) >= 0.9


def test_first_like_against_all_pairs(spark):
    part = spark.read.parquet(f"{SF}/part.parquet").select("p_partkey", "p_name").collect()
    asked = {r[0] for r in spark.read.parquet(f"{SF}/part.parquet").select(dictionary._misspelt(dictionary.F.col("p_name"), dictionary.F.col("p_partkey"))).collect()}
    first = {}
    for r in sorted(part):
        first.setdefault(r.p_name.lower().strip(), r.p_partkey)
    wanted = {}
    for a in {a.lower().strip() for a in asked}:
        like = [n for n in first if similarity.sequence_ratio(a, n) > 0.85]
        if like:
            wanted[a] = min(like, key=first.get)
    assert {r.term: r.match for r in dictionary.first_like_names(spark, SF).collect()} == wanted
