"""Publication years by vote over a text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Groups of words; each group near a year adds two to its vote.
NEAR_WORDS = [r"Published", r"©|Copyright", r"Accepted", r"Received", r"Version of Record", r"Issue", r"Volume", r"Proceedings"]
YEAR = r"\b(?:19|20)\d\d\b"


def vote(texts: DataFrame, latest: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, year): each 4-digit year from 1900 to ``latest`` has one vote a place, and two more for each group of words within 40 characters of it.

    Ties take the latest. The stretches of text around years don't overlap and
    don't cross lines, so a year inside the 40 characters after another one has
    its plain vote only.
    """
    lines = texts.select(key, F.explode(F.split(text, "\n")).alias("line")).where(F.col("line").rlike(YEAR))
    plain = lines.select(key, F.explode(F.regexp_extract_all("line", F.lit(rf"({YEAR})"), F.lit(1))).alias("year"), F.lit(1).alias("w"))
    around = rf"(.{{0,40}})({YEAR})(.{{0,40}})"
    near = lines.select(key, F.explode(F.regexp_extract_all("line", F.lit(around), F.lit(0))).alias("span"))
    near = near.select(key, F.regexp_extract("span", around, 2).alias("year"), "span")
    boost = sum((F.when(F.col("span").rlike(f"(?i){words}"), 2).otherwise(0) for words in NEAR_WORDS), F.lit(0))
    votes = plain.unionByName(near.select(key, "year", boost.alias("w"))).withColumn("year", F.col("year").cast("int"))
    return votes.where(F.col("year").between(1900, latest)).groupBy(key, "year").agg(F.sum("w").alias("w")).groupBy(key).agg(F.max(F.struct("w", "year"))["year"].alias("year"))


def full_year(short: Column, this_year: int) -> Column:
    """A two-digit year as four digits; those beyond next year belong to the century before."""
    return F.when(short <= this_year % 100 + 1, short + 2000).otherwise(short + 1900)


def year_of_name(name: Column, this_year: int) -> Column:
    """The year in a paper's file name, by the newer or else the older numbering; null without either."""
    base = F.substring_index(name, "/", -1)
    newer = F.regexp_extract(base, r"(?<!\d)(\d{2})\d{2}\.\d{4,5}(?:v\d+)?\.pdf$", 1)
    older = F.regexp_extract(base, r"[_/](\d{2})\d{2}\d{3,5}(?:v\d+)?\.pdf$", 1)
    return full_year(F.coalesce(F.nullif(newer, F.lit("")), F.nullif(older, F.lit(""))).cast("int"), this_year)
