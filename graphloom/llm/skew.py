"""Joins on a key of which a few values may hold a third of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a key that one task should get, and the most keys above it that are broadcast (about 24 bytes each).
PER_TASK, MOST_KEYS = 1000, 100_000


def hot_keys(counts: DataFrame, key: str, copies: str) -> DataFrame | None:
    """(key, salts_) of the keys with more than PER_TASK rows; None if there are none.

    Of more than MOST_KEYS such keys, those with the most rows are taken: what a
    key beyond them has is then at most one of MOST_KEYS parts of all rows.
    ``counts`` is a written table.
    """
    hot = counts.where(F.col(copies) > PER_TASK).select(key, F.ceil(F.col(copies) / PER_TASK).cast("long").alias("salts_"))
    found = hot.count()
    return None if not found else hot if found <= MOST_KEYS else hot.orderBy(F.desc("salts_"), key).limit(MOST_KEYS)


def salted_join(left: DataFrame, right: DataFrame, key: str, by: list[str], hot: DataFrame | None, how: str = "inner") -> DataFrame:
    """``left`` joined to ``right`` (few rows a key) on ``key``; rows of hot keys are dealt over salts by the columns ``by``."""
    if hot is None:
        return left.join(right, key, how)
    salt = F.coalesce(F.pmod(F.xxhash64(*by), F.col("salts_")), F.lit(0)).alias("salt_")
    dealt = left.join(F.broadcast(hot), key, "left").select(*left.columns, salt)
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("salts_", F.lit(1).cast("long")) - 1)).alias("salt_")
    copies = right.join(F.broadcast(hot), key, "left").select(*right.columns, every)
    return dealt.join(copies, [key, "salt_"], how).drop("salt_")
