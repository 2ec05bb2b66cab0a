"""Operator 6: benchmark decontamination by SimHash windows, with SQL functions only.

Texts and items become lower-cased words (white space and ASCII punctuation
separate) and bags of 5-word shingles. Each document is looked at through
windows as long as each item. A window without any shingle of an item has
similarity 0 to it, so only windows that line up with a shared shingle are
fingerprinted. A 64-bit SimHash weighs shingles by how often they occur.

Fingerprints are cut into ``RADIUS`` + 1 blocks: two that differ in at most
RADIUS bits agree in a block, so joining on (length, block, its bits) finds all
pairs within the radius. The Hamming distance of what is found is checked, and
then the exact weighted similarity, sum of lesser counts over sum of greater
counts, which must reach ``LEAST`` (0.8).

RADIUS is 19: at similarity 0.8 the expected distance is 9.7 bits with a
standard deviation of 2.9.

Items' shingles and fingerprints are broadcast only while they are few (their
number is checked); else they are joined by shuffle. Items and documents with
fewer than 5 words have no shingle and match nothing, as do null and empty
texts. Items with equal words are all reported. Rows that repeat a document id
are looked at together. Empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.arrays import let
from graphloom.llm.store import written

K, RADIUS, LEAST = 5, 19, 0.8
BLOCKS = [(64 * i // (RADIUS + 1), 64 * (i + 1) // (RADIUS + 1)) for i in range(RADIUS + 1)]
#: Shingles of all items that may be broadcast (24 bytes each).
BROADCAST_SHINGLES = 200_000


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\s\p{Punct}]+", -1), "")


def shingles(text: Column) -> Column:
    """Hashes of the 5-word shingles in order; empty for fewer words."""

    def of(w: Column) -> Column:
        many = F.transform(F.sequence(F.lit(0), F.size(w) - K), lambda i: F.xxhash64(*(F.get(w, i + j) for j in range(K))))
        return F.when(F.size(w) >= K, many).otherwise(F.array().cast("array<bigint>"))

    return let(words(text), of)


def simhash(bag: Column) -> Column:
    """Bit b is set where more shingles of the bag have it set than not."""

    def votes(bit: Column) -> Column:
        return F.aggregate(bag, F.lit(0), lambda a, s: a + F.when(F.getbit(s, bit) == 1, 1).otherwise(-1))

    one = F.lit(1).cast("long")
    parts = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda b: F.when(votes(b) > 0, F.call_function("shiftleft", one, b)).otherwise(F.lit(0).cast("long")))
    return F.aggregate(parts, F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(x))


def block_keys(fingerprint: Column) -> Column:
    return F.array(*(F.struct(F.lit(i).alias("block"), F.shiftrightunsigned(fingerprint, lo).bitwiseAND((1 << (hi - lo)) - 1).alias("bits")) for i, (lo, hi) in enumerate(BLOCKS)))


def tagged(bag: Column) -> Column:
    """A bag as a set: each shingle with its number among its equals."""
    return let(F.array_sort(bag), lambda s: F.transform(s, lambda x, i: F.xxhash64(x, i - F.array_position(s, x).cast("int"))))


def similarity(a: Column, b: Column) -> Column:
    shared = F.size(F.array_intersect(a, b))
    return shared / (F.size(a) + F.size(b) - shared)


def matches(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(doc_id, item_id, start, n_words, similarity): the best window of each document for each item."""
    item = items.select(F.col(item_id).alias("item"), shingles(F.col(text)).alias("bag")).where(F.size("bag") > 0)
    item = written(item, "item_bags")
    members = item.select("item", F.sha2(F.to_json("bag"), 256).alias("digest")).distinct()
    reps = members.groupBy("digest").agg(F.min("item").alias("rep"))
    members = members.join(reps, "digest").select(F.col("rep").alias("member_rep"), "item")
    item = item.groupBy("bag").agg(F.min("item").alias("rep"))
    item = written(item.select("rep", "bag", F.size("bag").alias("length"), simhash(F.col("bag")).alias("item_fp"), tagged(F.col("bag")).alias("item_set")), "items")
    total = item.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    small = F.broadcast if total <= BROADCAST_SHINGLES else lambda df: df

    known = item.select(F.posexplode("bag").alias("item_pos", "known"), "length").distinct()
    base = docs.select(F.col(doc_id).alias("doc"), F.col(text).alias("text_"))
    at = base.select("doc", F.posexplode(shingles(F.col("text_"))).alias("pos", "shingle"))
    hits = at.join(small(known), F.col("shingle") == F.col("known"))
    # Starts are bounded by each document's own length further down.
    wanted = hits.select("doc", F.struct("length", F.greatest(F.col("pos") - F.col("item_pos"), F.lit(0)).alias("start")).alias("w")).groupBy("doc").agg(F.collect_set("w").alias("wanted"))
    wanted = written(wanted.withColumnRenamed("doc", "hit_doc"), "windows")

    def window(all_: Column, w: Column) -> Column:
        start = F.greatest(F.least(w["start"], F.size(all_) - w["length"]), F.lit(0))
        return F.struct(start.alias("start"), w["length"].alias("length"), F.slice(all_, start + 1, w["length"]).alias("window"))

    cut = base.join(wanted, F.col("doc").eqNullSafe(F.col("hit_doc"))).select("doc", F.inline(F.array_distinct(let(shingles(F.col("text_")), lambda all_: F.transform("wanted", lambda w: window(all_, w))))))
    cut = written(cut.where(F.size("window") > 0).withColumn("fp", simhash(F.col("window"))), "fingerprints")

    sides = [
        cut.select("doc", "start", "length", "fp", F.inline(block_keys(F.col("fp")))),
        item.select(F.col("length").alias("length_"), "item_fp", "rep", F.inline(block_keys(F.col("item_fp")))).withColumnsRenamed({"block": "block_", "bits": "bits_"}),
    ]
    met = (F.col("length") == F.col("length_")) & (F.col("block") == F.col("block_")) & (F.col("bits") == F.col("bits_"))
    near = sides[0].join(small(sides[1]), met).where(F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= RADIUS)
    near = near.select(F.col("doc").alias("near_doc"), F.col("start").alias("near_start"), F.col("length").alias("near_length"), F.col("rep").alias("near_item")).distinct()
    pairs = near.join(cut, F.col("near_doc").eqNullSafe(F.col("doc")) & (F.col("near_start") == F.col("start")) & (F.col("near_length") == F.col("length")))
    pairs = pairs.join(small(item.select("rep", "item_set")), F.col("near_item") == F.col("rep"))
    sure = pairs.withColumn("similarity", similarity(tagged(F.col("window")), F.col("item_set"))).where(F.col("similarity") >= LEAST)
    best = sure.groupBy("doc", "rep").agg(F.max(F.struct("similarity", (-F.col("start")).alias("back"), "length")).alias("best"))
    # Items with equal words meet their representative's matches last, so no list of them is made.
    return best.join(members, F.col("rep") == F.col("member_rep")).select(
        F.col("doc").alias(doc_id),
        F.col("item").alias(item_id),
        (-F.col("best.back")).cast("long").alias("start"),
        (F.col("best.length") + K - 1).cast("long").alias("n_words"),
        F.col("best.similarity").alias("similarity"),
    )


def clean(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text") -> DataFrame:
    """``docs`` without the rows whose id matches an item; rows with a null id stay unless they match."""
    bad = matches(docs, items, doc_id, item_id, text).select(F.col(doc_id).alias("bad_doc_")).distinct()
    return docs.join(bad, docs[doc_id].eqNullSafe(bad["bad_doc_"]), "left_anti")
