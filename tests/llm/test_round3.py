"""The rules of the URL filter's contract, and the last join of near duplicates."""

import random
from pathlib import Path

import numpy as np
from pyspark.sql import functions as F

import __spark_entry__ as driver
from graphloom.llm import parity_join
from graphloom.llm.store import Scratch
from test_parity_join import brute, found


def verdicts(spark, top: Path, urls):
    spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").write.parquet(f"{top}/pages.parquet")
    return [r.verdict for r in driver.queries()["op3_url_filter"](spark, str(top)).orderBy("page_id").collect()]


def test_each_rule_has_the_word_of_its_contract(spark, tmp_path):
    urls = ["a://com/en/1", "a://x.com/en/1", "a://example.com/en/7", "a://net/de/1", "a://m.other.net/de/8", "a://example.net/de/7", "a://example.net/de/8", "a://www.example.net/de/80", "a://org/es/1"]
    assert verdicts(spark, tmp_path, urls) == ["block", "block", "allow", "allow", "allow", "allow", "block", "block", "block"]


def test_long_sets_that_differ_too_much_are_not_paired(spark, monkeypatch):
    """Copies of one text of over 512 shingles, most of which differ by more than a link allows."""
    rng, counts, write = random.Random(5), {}, Scratch.write

    def counted(self, df, name):
        out = write(self, df, name)
        counts[name] = out.count()
        return out

    monkeypatch.setattr(Scratch, "write", counted)
    words = [f"w{i}" for i in range(900)]
    rows = []
    for doc in range(60):
        copy = list(words)
        for at in rng.sample(range(900), rng.choice([14, 22, 24])):
            copy[at] = f"x{doc}y{at}"
        rows.append((doc, " ".join(copy)))
    got = parity_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85)
    assert found(got) == brute(rows, 4, 85)
    assert counts["marked"] > 0 and counts["across"] < 60


def test_folded_sketches(spark):
    hashes = np.arange(1, 3000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    bits = parity_join.bit_sketch(hashes)
    folded = np.bitwise_xor.reduce(bits.reshape(-1, 16), axis=0)
    row = spark.createDataFrame([([int(x) for x in bits.view(np.int64)],)], "bits array<long>")
    one = row.select(parity_join._folded(F.col("bits"), 1024).alias("b"), parity_join._folded(F.col("bits"), 1 << 14).alias("same")).first()
    assert one.b == [int(x) for x in folded.view(np.int64)] and one.same == [int(x) for x in bits.view(np.int64)]
