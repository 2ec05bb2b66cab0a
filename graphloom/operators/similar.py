"""A similarity join of names that finds every pair above a ratio, without comparing all of them.

The ratio of two strings is twice their common characters (in order) by the sum
of their lengths. From a ratio follow bounds for each pair of lengths: on the
length of the common subsequence, hence on the characters that either string
loses, hence on the two-letter grams that both must share, since a lost
character takes at most two grams with it and a gained one at most one. So
strings only meet where they share one of their rarest grams, as many of which
are looked at as the bound leaves open. Where the bound leaves no gram (very
short strings) they meet by single characters in the same way. No pair above
the ratio is lost, whatever letters it differs in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.similarity import ratio_udf, sequence_udf
from graphloom.operators.steps import FEW, cut

#: Strings with a gram from which it counts as common: grams below are told apart by their hashes alone.
COMMON = 1000


def _common(n: Column, m: Column, least: float) -> Column:
    """The least length of a common subsequence of strings of ``n`` and ``m`` characters."""
    return F.ceil((n + m) * (least / 2) - 1e-9)


def _partners(n: Column, least: float) -> Column:
    """The lengths that a string's partners can have."""
    return F.sequence(F.greatest(F.lit(1).cast("bigint"), F.ceil(n * (least / (2 - least)) - 1e-9)), F.floor(n * ((2 - least) / least) + 1e-9))


def _grams(x: Column, size: int) -> Column:
    places = F.sequence(F.lit(1), F.greatest(F.length(x) - (size - 1), F.lit(1)))
    return F.when(F.length(x) >= size, F.array_distinct(F.transform(places, lambda i: F.substring(x, i, F.lit(size))))).otherwise(F.array().cast("array<string>"))


def _shared(n: Column, m: Column, size: int, different: Column, least: float) -> Column:
    """How many of a string's ``different`` grams a partner of ``m`` characters shares at least; each lost character takes ``size`` of them, each gained one ``size - 1``."""
    common = _common(n, m, least)
    return different - size * (n - common) - (size - 1) * (m - common)


def _keys(strings: DataFrame, least: float) -> DataFrame:
    """(side, s, key, rest): the keys by which the strings of both sides meet, each with its string's other keys."""
    n = F.length("s").cast("bigint")
    base = strings.where(n > 0).select("side", "s", _grams(F.col("s"), 2).alias("two"), _grams(F.col("s"), 1).alias("one"))
    low = F.array_min(F.transform(_partners(n, least), lambda m: _shared(n, m, 2, F.size("two"), least)))
    one = F.array_min(F.transform(_partners(n, least), lambda m: F.size("one") - (n - _common(n, m, least))))
    looked = lambda different, bound: (different - F.greatest(bound, F.lit(1)) + 1).cast("int")
    sized = base.withColumns({"low": low, "k2": looked(F.size("two"), low), "k1": F.when(low <= 0, looked(F.size("one"), one)).otherwise(0)})
    both = F.concat(F.transform("two", lambda g: F.struct(F.lit(2).alias("kind"), g.alias("gram"))), F.when(F.col("low") <= 0, F.transform("one", lambda g: F.struct(F.lit(1).alias("kind"), g.alias("gram")))).otherwise(F.array().cast("array<struct<kind:int,gram:string>>")))
    each = cut(sized.select("side", "s", "k1", "k2", F.explode(both).alias("g")))
    counted = each.groupBy(F.col("g").alias("c")).agg(F.count("*").alias("n_common")).where(F.col("n_common") > COMMON)
    counted = cut(counted)
    counted = F.broadcast(counted) if counted.count() <= FEW else counted
    ranked = each.join(counted, F.col("g") == F.col("c"), "left").select("side", "s", "k1", "k2", "g.kind", F.struct(F.coalesce("n_common", F.lit(0).cast("bigint")).alias("n"), F.xxhash64("g").alias("h"), F.col("g.gram").alias("gram")).alias("key"))
    chosen = ranked.groupBy("side", "s", "kind").agg(F.slice(F.array_sort(F.collect_list("key")), F.lit(1), F.first(F.when(F.col("kind") == 2, F.col("k2")).otherwise(F.col("k1")))).alias("rest"))
    return chosen.select("side", "s", "kind", F.col("rest.h").alias("rest"), F.explode("rest.h").alias("key"))


def similar(left: DataFrame, right: DataFrame, least: float, measure: str = "ratio", strict: bool = False) -> DataFrame:
    """(left, right, score) of the different strings of two one-column tables whose ``measure`` is at least (or above) ``least``, 0 to 1.

    ``ratio`` counts a longest common subsequence, ``sequence`` matching blocks,
    which are never longer. Null and empty strings are like nothing; equal
    strings are pairs as well. There is no limit on names, and none of a group of
    names with one common gram meet by it unless they have too few rarer ones.
    """
    if measure not in ("ratio", "sequence"):
        raise ValueError("measure is ratio or sequence")
    sides = [t.select(F.lit(i).alias("side"), F.col(t.columns[0]).alias("s")).where("s <> ''").distinct() for i, t in enumerate((left, right))]
    keys = cut(_keys(sides[0].union(sides[1]), least))
    a = keys.where("side = 0").select(F.col("s").alias("left"), "kind", "key", F.col("rest").alias("rest_a"))
    b = keys.where("side = 1").select(F.col("s").alias("right"), "kind", "key", F.col("rest").alias("rest_b"))
    n, m = F.length("left").cast("bigint"), F.length("right").cast("bigint")
    # A pair is looked at where its first shared key is, so it is verified once a kind.
    first = F.get(F.array_intersect("rest_a", "rest_b"), F.lit(0)) == F.col("key")
    lengths = (n * (2 - least) >= m * least - 1e-9) & (m * (2 - least) >= n * least - 1e-9)
    grams = F.size(F.array_intersect(_grams(F.col("left"), 2), _grams(F.col("right"), 2)))
    enough = (grams >= _shared(n, m, 2, F.size(_grams(F.col("left"), 2)), least)) & (grams >= _shared(m, n, 2, F.size(_grams(F.col("right"), 2)), least))
    pairs = a.join(b, ["kind", "key"]).where(lengths & first).where(enough).select("left", "right").distinct()
    score = ratio_udf("left", "right") / 100 if measure == "ratio" else sequence_udf("left", "right")
    scored = pairs.withColumn("score", score)
    return scored.where(F.col("score") > least) if strict else scored.where(F.col("score") >= least)
