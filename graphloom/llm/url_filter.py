"""Operator 3: URL filter. Rules by host and path first, then a blocked Bloom filter and an exact join.

The list of blocked URLs can be of any size. Its canonical URLs set bits in a
filter of 512-bit blocks; each URL touches one block, so probing is one join on
the block's number. Block rows are broadcast only while their number is known
to be small; past that they are joined by shuffle. What passes the filter is
joined to the list itself on the canonical URL, which removes false positives.

Null URLs and URLs without ``://`` have empty host and path, fit no rule, are
on no list, and are allowed. Repeated rows are kept. An empty list blocks nothing.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A block is eight 64-bit words; each URL sets one bit in each word.
WORDS = 8
BITS_PER_URL = 16
#: Blocks of 72 bytes, so at most about 5 MB are broadcast.
BROADCAST_BLOCKS = 65_536
#: Rules are compiled into one expression; more belong in the list.
MOST_RULES = 256


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case."""
    host = F.regexp_extract(_rest(url), r"^[^/?#]*", 0)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(_rest(url), r"(?s)^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    return F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))


def canonical(host: Column, path: Column) -> Column:
    """Host without ``www.`` or ``m.``, path without ``.html`` or a last ``/``; empty where the host is."""
    bare = F.regexp_replace(host, r"^(www|m)\.", "")
    return F.when(host == "", F.lit("")).otherwise(F.concat(bare, F.regexp_replace(path, r"(\.html|/)\z", "")))


def first_rule(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """Verdict and text of the longest rule that fits, else nulls."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"at most {MOST_RULES} rules; put single URLs on the list")
    verdict, text = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.host) + len(r.path), r)):
        fits = ((host == r.host) | host.endswith(f".{r.host}")) & path.startswith(r.path)
        verdict = F.when(fits, F.lit(r.verdict)).otherwise(verdict)
        text = F.when(fits, F.lit(r.host + r.path)).otherwise(text)
    return verdict, text


def _block(url: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(url), F.lit(blocks))


def _bit(url: Column, word: int) -> Column:
    """One bit of a word, from hash bits that are independent of the block's number."""
    at = F.shiftrightunsigned(F.xxhash64(F.lit("bit"), url), 6 * word).bitwiseAND(63).cast("int")
    return F.call_function("shiftleft", F.lit(1).cast("long"), at)


def bloom(listed: DataFrame, column: str, blocks: int) -> DataFrame:
    """Rows (block, w0 .. w7) of the blocks that have bits."""
    words = [F.bit_or(_bit(F.col(column), i)).alias(f"w{i}") for i in range(WORDS)]
    return listed.groupBy(_block(F.col(column), blocks).alias("block")).agg(*words)


def listed_urls(df: DataFrame, listed: DataFrame, url: str) -> DataFrame:
    """The distinct values of ``df[url]`` that are in ``listed`` (one column ``listed_url``, any order, repeats allowed)."""
    listed = listed.where("listed_url <> ''").distinct()
    count = listed.count()
    blocks = max(1, -(-count * BITS_PER_URL // (64 * WORDS)))
    filter_rows = bloom(listed, "listed_url", blocks)
    if blocks <= BROADCAST_BLOCKS:
        filter_rows = F.broadcast(filter_rows)
    asked = df.select(F.col(url).alias("asked_url")).where("asked_url <> ''").distinct()
    asked = asked.withColumn("block", _block(F.col("asked_url"), blocks))
    hit = F.lit(True)
    for i in range(WORDS):
        hit = hit & (F.col(f"w{i}").bitwiseAND(_bit(F.col("asked_url"), i)) != 0)
    possible = asked.join(filter_rows, "block").where(hit).select("asked_url")
    return possible.join(listed, F.col("asked_url") == F.col("listed_url"), "left_semi")


def judge(df: DataFrame, listed: DataFrame, rules: Sequence[Rule], url: str = "url") -> DataFrame:
    """``df`` with host, path, rule and verdict; columns of these names are replaced."""
    made = ["host", "path", "rule", "verdict"]
    df = df.drop(*made)
    host, path = F.coalesce(host_of(F.col(url)), F.lit("")), F.coalesce(path_of(F.col(url)), F.lit(""))
    parts = df.withColumns({"host": host, "path": path})
    verdict, rule = first_rule(F.col("host"), F.col("path"), rules)
    parts = parts.withColumns({"rule": rule, "rule_verdict_": verdict, "asked_url_": canonical(F.col("host"), F.col("path"))})
    found = listed_urls(parts.where("rule is null"), listed, "asked_url_").select(F.col("asked_url").alias("asked_url_"), F.lit(True).alias("on_list_"))
    out = parts.join(found, "asked_url_", "left")
    by_list = F.when(F.col("on_list_"), F.lit("block")).otherwise(F.lit("allow"))
    return out.withColumn("verdict", F.coalesce("rule_verdict_", by_list)).select(*df.columns, *made)
