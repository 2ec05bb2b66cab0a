"""Vectors of texts. An encoder is any function from rows (id, text) to rows (id, vec); this one needs no model.

Words are hashed to ``dims`` places, weighed by how often a text has them and
how few texts do, and scaled to length one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.text import tokens

Encoder = Callable[[DataFrame], DataFrame]
#: Most places, since their weights are a table that is broadcast.
MOST_PLACES = 65_536


def place_of(word: Column, dims: int) -> Column:
    """The place of a word: the first 32 bits of its MD5 digest, modulo ``dims``."""
    return F.pmod(F.conv(F.left(F.md5(word.cast("binary")), F.lit(8)), 16, 10).cast("bigint"), F.lit(dims)).cast("int")


def counts(texts: DataFrame, dims: int) -> DataFrame:
    """(id, place, n) of texts (id, text), added up in each task first."""
    words = texts.select("id", F.explode(tokens(F.coalesce("text", F.lit("")))).alias("word"))
    return words.groupBy("id", place_of(F.col("word"), dims).alias("place")).agg(F.count("*").alias("n"))


def weights(counted: DataFrame, total: int) -> DataFrame:
    """(place, idf): at most one row a place."""
    return counted.groupBy(F.col("place").alias("p")).agg(F.count("*").alias("texts")).select("p", (F.log(F.lit(1.0 + total) / (F.col("texts") + 1)) + 1).alias("idf"))


def hashed_encoder(dims: int = 256) -> Encoder:
    """An encoder that fits its weights on the texts which it is given. Texts without a word get a vector of zeros; ids are expected once each."""
    if dims > MOST_PLACES:
        raise ValueError(f"at most {MOST_PLACES} places")

    def encode(texts: DataFrame) -> DataFrame:
        counted = counts(texts, dims)
        idf = F.broadcast(weights(counted, texts.count()))
        weighed = counted.join(idf, F.col("place") == F.col("p")).select("id", "place", (F.col("n") * F.col("idf")).alias("w"))
        rows = weighed.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("place", "w"))).alias("parts"))
        size = F.sqrt(F.aggregate("parts", F.lit(0.0), lambda a, x: a + x["w"] * x["w"]))
        placed = F.map_from_entries("parts")
        return texts.select("id").join(rows.select("id", placed.alias("m"), size.alias("size")), "id", "left").select("id", dense(F.col("m"), F.col("size"), dims).alias("vec"))

    return encode


def dense(placed: Column, size: Column, dims: int) -> Column:
    """The values of a map from places to numbers, divided by ``size``, as an array with zeros elsewhere."""
    steps = F.array_sort(F.map_entries(placed))
    # A walk along the sorted places appends the zeros between two of them and the value, so each place is made once.
    empty = F.array().cast("array<double>")
    walked = F.aggregate(steps, empty, lambda out, e: F.concat(out, F.array_repeat(F.lit(0.0), e["key"] - F.size(out)), F.array(e["value"] / size)))
    return F.concat(F.coalesce(walked, empty), F.array_repeat(F.lit(0.0), F.lit(dims) - F.coalesce(F.size(walked), F.lit(0))))
