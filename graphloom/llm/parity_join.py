"""Operator 1: n-gram Jaccard join by parity sketches.

A document is the set of its distinct k-word shingles. Sizes fall into bands
that double. In a band, shingles are dealt by hash into parts, and each part's
shingles are XOR-ed into a 64-bit sketch. A shingle that only one of two sets
has changes one part's sketch, so sets that differ in d shingles have all but d
sketches equal. A set of n shingles differs from any partner by at most D(n),
so it needs the sketches of its first D(n) + 1 parts only: of the parts that
both sets of a linked pair have, one at least agrees. Pairs are found by
joining on (band, part, sketch), and verified on the whole sets.

A part without shingles says nothing, and would put all documents of a band
together. Sets take ``spare`` parts more than D(n) + 1, so a pair agrees in at
least spare + 1 parts, and empty parts can be left out as long as a document
has at most ``spare`` of them. If both have more, the pair is found under the
next of ``SEEDS`` ways of dealing, which only such documents use; the last way
keeps its empty parts. Nothing is lost at any step.

Equal sets are one class, joined through its least document. A bucket is the
sets that agree in a sketch. Buckets of two or three are known from the one
aggregate that finds them (count, least, greatest, XOR of ids); only larger
ones are joined again. Of these each set is paired with one other set, the
least of all its buckets, then, for a few rounds and as long as its buckets
hold several components, with the one that a hash of a bucket chooses. This
joins most of a large group with one pair a set and round. Sets of a bucket
that are then still in different components are paired completely, so no link
between components is missed; links inside a component can't change it. No
step collects ids, links or groups.

A second sketch, of at least two bits a shingle, of which each shingle flips
one, is compared before sets are fetched: its Hamming distance is at most the
symmetric difference, so pairs in which it is too great are no links. Sketches
of two lengths are compared after the longer one is folded.

Null and empty texts, and texts without words, have no shingles and link with
nothing. Texts with fewer words than k have one shingle, all their words. Very
long texts are used whole, one at a time. Rows that repeat a doc_id are one
document with several sets: it has the links of all of them, and each row is
returned with its own size. Rows with a null id are returned as their own
class, without component. Extra columns aren't read. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm import textvec as tv
from graphloom.llm.components import components
from graphloom.llm.store import Scratch, written

SEEDS = 4
GROWTH = 2
#: Bits of the least and greatest bit sketch.
BITS, MOST_BITS = 1024, 1 << 20
#: Bits of the sketches that rows of the last join carry; longer ones are folded to these.
JOIN_BITS = 1 << 14
#: Rounds of hashed pivots before sets in different components are paired completely.
PIVOT_ROUNDS = 3
#: Copies from which a class is joined back by broadcast, and the most such classes that are (32 bytes each).
HOT_COPIES, HOT_CLASSES = 1000, 100_000


def _apart(n: int, high: int, percent: int) -> int:
    """The most shingles by which a set of ``n`` differs from a partner of at most ``high``."""
    # |a ^ b| <= (1 - t) / (1 + t) * (|a| + |b|), and |b| <= |a| / t.
    return (100 - percent) * (n + max(min(high, n * 100 // percent), n)) // (100 + percent)


def _spare(least: int, high: int, percent: int) -> int:
    """The fewest spare parts that cover the empty ones by three deviations; for small sets, those that come nearest to it."""
    best, most = 0, -math.inf
    for spare in range(least + 1):
        empty = (_apart(least, high, percent) + 1 + spare) * math.exp(-least / (_apart(high, high, percent) + 1 + spare))
        margin = (spare - empty) / math.sqrt(empty)
        if margin >= 3:
            return spare
        if margin > most:
            best, most = spare, margin
    return best


@lru_cache(maxsize=None)
def bands(percent: int, most: int) -> list[tuple[int, int, int, int]]:
    """(least size, greatest size, parts, spare parts) of each band up to ``most`` shingles."""
    out, low = [], 1
    while low <= most:
        high = max(low, math.ceil(low * GROWTH) - 1)
        apart = _apart(high, high, percent)
        spare = _spare(-(-percent * low // 100), high, percent) if apart else 0
        out.append((low, high, apart + 1 + spare, spare))
        low = high + 1
    return out


def sketch_keys(hashes: np.ndarray, percent: int) -> np.ndarray:
    """The join keys of one set: a hash of (band, seed, part, sketch) for each part that counts."""
    n, out = len(hashes), []
    for number, (low, high, parts, spare) in enumerate(bands(percent, _round_up(n * 100 // percent + 1))):
        # As the greater of a pair the set is in its own band, as the lesser one in any that its size still fits.
        if n > high or n * 100 < percent * low:
            continue
        first_parts = min(parts, _apart(n, high, percent) + 1 + spare)
        for seed in range(SEEDS):
            dealt = tv.mix(hashes + tv.U64(seed * 2 + 1) * tv.STEP)
            part = ((dealt >> tv.U64(32)) * tv.U64(parts) >> tv.U64(32)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            filled, first = np.unique(part[order], return_index=True)
            sketch = np.bitwise_xor.reduceat(dealt[order], first)
            used = int(np.searchsorted(filled, first_parts))
            filled, sketch = filled[:used], sketch[:used]
            label = (number * SEEDS + seed) << 40
            keys = tv.mix(sketch ^ tv.mix(np.array(filled + label, tv.U64) * tv.BASE))
            out.append(keys)
            missing = first_parts - used
            if missing <= spare:
                break
            if seed == SEEDS - 1:
                absent = np.setdiff1d(np.arange(first_parts), filled) + label + (1 << 32)
                out.append(tv.mix(absent.astype(tv.U64) * tv.BASE))
    return np.concatenate(out) if out else np.zeros(0, tv.U64)


def _round_up(n: int) -> int:
    """Few distinct values, so that the bands are computed once for many sizes."""
    return 1 << max(10, n.bit_length())


def bit_sketch(hashes: np.ndarray) -> np.ndarray:
    """The parities of the shingles that fall to each bit, as longs; a power of two of bits, twice the shingles or more."""
    bits = min(max(BITS, 1 << (2 * len(hashes) - 1).bit_length()), MOST_BITS) if len(hashes) else BITS
    odd = np.bincount((tv.mix(hashes ^ tv.STEP) % tv.U64(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(tv.U64)


def _folded(bits: Column, most: int) -> Column:
    """A bit sketch of at most ``most`` bits: the XOR of the pieces of a longer one, which shingles flip alike."""
    longs = most // 64
    piece = lambda i: F.slice(bits, i * longs + 1, F.lit(longs))
    pieces = F.sequence(F.lit(1), (F.size(bits) / longs).cast("int") - 1)
    return F.when(F.size(bits) <= longs, bits).otherwise(F.aggregate(pieces, F.slice(bits, 1, longs), lambda out, i: F.zip_with(out, piece(i), lambda p, q: p.bitwiseXOR(q))))


def _may_link(a: tuple[str, str], b: tuple[str, str], percent: int) -> Column:
    """Whether two sets, each (name of its size, name of its bit sketch), can reach the threshold."""
    size_a, size_b = F.col(a[0]), F.col(b[0])
    half = lambda x: (F.size(x) / 2).cast("int")
    fold = lambda x: F.zip_with(F.slice(x, F.lit(1), half(x)), F.slice(x, half(x) + 1, half(x)), lambda p, q: p.bitwiseXOR(q))
    level = lambda x, y: F.when(F.size(x) > F.size(y), fold(F.col(x))).otherwise(F.col(x))
    flipped = F.aggregate(F.zip_with(level(a[1], b[1]), level(b[1], a[1]), lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda n, x: n + F.coalesce(x, F.lit(0)))
    # 100 * shared >= percent * union, in terms of the symmetric difference.
    near = flipped.cast("long") * (100 + percent) <= (size_a + size_b) * (100 - percent)
    return (F.least(size_a, size_b) * 100 >= F.greatest(size_a, size_b) * percent) & F.coalesce(near, F.lit(True))


def sketches(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """(doc, n_shingles, d1, d2, bits, keys): set sizes, two 64-bit digests of the sets, their bit sketches and join keys."""
    tv.arrow_limits(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tv.rounds(batch, "text_"):
                sets = tv.shingle_sets(part.column("text_"), k)
                keys = [sketch_keys(s, percent) if len(s) else s for s in sets]
                digests = [[int(f(tv.mix(s ^ salt)) if len(s) else 0) for s in sets] for f, salt in ((np.bitwise_xor.reduce, tv.BASE), (np.sum, tv.STEP))]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc"),
                        pa.array([len(s) for s in sets], pa.int64()),
                        *(pa.array(np.array(d, tv.U64).view(np.int64)) for d in digests),
                        tv.list_array([bit_sketch(s) for s in sets], pa.int64()),
                        tv.list_array(keys, pa.int64()),
                    ],
                    ["doc", "n_shingles", "d1", "d2", "bits", "keys"],
                )

    return docs.mapInArrow(run, "doc long, n_shingles long, d1 long, d2 long, bits array<long>, keys array<long>")


def shingle_table(docs: DataFrame, k: int) -> DataFrame:
    """(doc, shingles): the sorted shingle hashes of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tv.rounds(batch, "text_"):
                sets = tv.shingle_sets(part.column("text_"), k)
                yield pa.RecordBatch.from_arrays([part.column("doc"), tv.list_array(sets, pa.int64())], ["doc", "shingles"])

    return docs.mapInArrow(run, "doc long, shingles array<long>")


def possible(pairs: DataFrame, marks: DataFrame, percent: int) -> DataFrame:
    """Of the pairs (a, b), those that the bit sketches of ``marks`` (doc, n_shingles, bits) don't rule out."""
    left = pairs.join(marks.select(F.col("doc").alias("a"), F.col("n_shingles").alias("na"), F.col("bits").alias("bits_a")), "a")
    both = left.join(marks.select(F.col("doc").alias("b"), F.col("n_shingles").alias("nb"), F.col("bits").alias("bits_b")), "b")
    return both.where(_may_link(("na", "bits_a"), ("nb", "bits_b"), percent)).select("a", "b").distinct()


def verified(pairs: DataFrame, base: DataFrame, k: int, percent: int, tables: Scratch) -> DataFrame:
    """Of the candidate pairs (a, b), those whose sets reach the threshold."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    sets = tables.write(shingle_table(base.join(ids, F.col("doc") == F.col("id"), "left_semi"), k), "sets")
    left = pairs.join(sets.select(F.col("doc").alias("a"), F.col("shingles").alias("sa")), "a")
    both = left.join(sets.select(F.col("doc").alias("b"), F.col("shingles").alias("sb")), "b")
    shared = F.size(F.array_intersect("sa", "sb"))
    union = F.size("sa") + F.size("sb") - shared
    links = tables.write(both.where(100 * shared.cast("long") >= percent * union.cast("long")).select("a", "b").distinct(), "links")
    tables.drop("sets")
    return links


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, n_equal, component_id) for each row of ``docs``.

    n_equal counts the documents with the same set; component_id is the least
    document that links reach.
    """
    base = docs.select(F.col(doc_id).cast("long").alias("doc"), F.col(text).alias("text_"))
    with Scratch(docs.sparkSession) as tables:
        known = tables.write(sketches(base, k, percent), "sketches")
        sizes = tables.write(known.select("doc", "n_shingles", "d1", "d2"), "sizes")
        full = sizes.where("n_shingles > 0 and doc is not null")
        classes = tables.write(full.groupBy("d1", "d2", "n_shingles").agg(F.min("doc").alias("rep"), F.count("*").alias("n_equal")), "classes")
        keyed = known.where("n_shingles > 0").join(classes.select("rep"), F.col("doc") == F.col("rep"), "left_semi")
        keyed = tables.write(keyed.select("doc", "n_shingles", "bits", "keys"), "keyed")
        tables.drop("sketches")
        found = _components_of(keyed, _same_id(full, classes), base, k, percent, tables)
        root = classes.join(found, F.col("rep") == F.col("node"), "left").select("d1", "d2", "n_shingles", "n_equal", F.coalesce("component", "rep").alias("root"))
        return written(_rows(sizes, root, doc_id), "near_duplicates")


def _same_id(full: DataFrame, classes: DataFrame) -> DataFrame:
    """(a, b) the classes of documents whose id has several sets."""
    own = F.struct("d1", "d2", "n_shingles")
    several = full.groupBy("doc").agg(F.min(own).alias("x"), F.max(own).alias("y")).where("x <> y").select("doc")
    reps = full.join(several, "doc", "left_semi").join(classes, ["d1", "d2", "n_shingles"]).select("doc", "rep")
    least = reps.groupBy(F.col("doc").alias("id")).agg(F.min("rep").alias("a"))
    return reps.join(least, F.col("doc") == F.col("id")).where("a <> rep").select("a", F.col("rep").alias("b")).distinct()


def _components_of(sets: DataFrame, given: DataFrame, base: DataFrame, k: int, percent: int, tables: Scratch) -> DataFrame:
    """(node, component) of the sets (doc, n_shingles, bits, keys) that link, and of the links ``given``."""
    marks = sets.select("doc", "n_shingles", "bits")
    every = sets.select("doc", F.explode("keys").alias("key"))
    met = every.groupBy("key").agg(F.min("doc").alias("low"), F.max("doc").alias("high"), F.count("*").alias("n"), F.bit_xor("doc").alias("odd")).where("low < high")
    met = tables.write(met, "buckets")
    large = met.where("n > 3").select(F.col("key").alias("met_key"), "low")
    crowd = tables.write(every.join(large, F.col("key") == F.col("met_key")).select("key", "doc", "low"), "crowd")

    def linked(now: DataFrame | None, pairs: DataFrame) -> DataFrame:
        """Components after the pairs (x, y) that link; those within a component need no look."""
        two = pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).where("a < b").distinct()
        two = tables.write(possible(two, marks, percent), "possible")
        if now is not None and two.isEmpty():
            return now
        links = verified(two, base, k, percent, tables)
        if now is not None:
            links = links.union(now.where("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b")))
        else:
            links = links.union(given)
        return components(tables.write(links, "edges"), tables, "components")

    third = F.col("odd").bitwiseXOR(F.col("low")).bitwiseXOR(F.col("high"))
    few = met.where("n <= 3").select("low", "high", F.when(F.col("n") == 3, third).alias("mid"))
    ends = lambda a, b: F.struct(F.col(a).alias("x"), F.col(b).alias("y"))
    few = few.select(F.inline(F.array(ends("low", "high"), ends("low", "mid"), ends("mid", "high")))).where("x is not null and y is not null")
    least = crowd.groupBy("doc").agg(F.min("low").alias("y")).select(F.col("doc").alias("x"), "y")
    found = linked(None, few.union(least))
    for turn in range(PIVOT_ROUNDS):
        mixed = _mixed(crowd, found, tables)
        if mixed.isEmpty():
            return found
        chosen = mixed.groupBy(F.col("key").alias("pivot_key")).agg(F.min(F.struct(F.xxhash64("key", "doc", F.lit(turn)).alias("h"), "doc", "c")).alias("pivot"))
        pivots = mixed.join(chosen, (F.col("key") == F.col("pivot_key")) & (F.col("c") != F.col("pivot.c")))
        found = linked(found, pivots.groupBy(F.col("doc").alias("x")).agg(F.min_by("pivot.doc", F.xxhash64("key", F.lit(turn))).alias("y")))
        crowd = mixed.select("key", "doc")
    # What is left is paired completely across components; bit sketches of all sets rule most pairs out inside the join.
    short = marks.withColumn("bits", _folded(F.col("bits"), JOIN_BITS))
    mixed = tables.write(_mixed(crowd, found, tables).join(short, "doc"), "marked")
    other = mixed.select(F.col("key").alias("key_b"), F.col("doc").alias("b"), F.col("c").alias("c_b"), F.col("n_shingles").alias("nb"), F.col("bits").alias("bits_b"))
    apart = (F.col("key") == F.col("key_b")) & (F.col("doc") < F.col("b")) & (F.col("c") != F.col("c_b"))
    across = mixed.join(other, apart & _may_link(("n_shingles", "bits"), ("nb", "bits_b"), percent)).select(F.col("doc").alias("x"), F.col("b").alias("y")).distinct()
    return linked(found, tables.write(across, "across"))


def _rows(sizes: DataFrame, root: DataFrame, doc_id: str) -> DataFrame:
    """Each row with its class's component; classes with many copies are broadcast, so no task gets all of one."""
    key = ["d1", "d2", "n_shingles"]
    hot = root.where(F.col("n_equal") >= HOT_COPIES)
    n_hot = hot.count()
    if 0 < n_hot <= HOT_CLASSES:
        rest = sizes.join(F.broadcast(hot.select(*key)), key, "left_anti").join(root.where(F.col("n_equal") < HOT_COPIES), key, "left")
        out = sizes.join(F.broadcast(hot), key).unionByName(rest)
    else:
        out = sizes.join(root, key, "left")
    own = F.when((F.col("n_shingles") == 0) | F.col("doc").isNull(), F.col("doc")).otherwise(F.col("root"))
    return out.select(F.col("doc").alias(doc_id), "n_shingles", F.coalesce("n_equal", F.lit(1)).alias("n_equal"), own.alias("component_id"))


def _mixed(crowd: DataFrame, found: DataFrame, tables: Scratch) -> DataFrame:
    """The rows of ``crowd`` in buckets with sets of several components ``c``."""
    labelled = crowd.join(found, F.col("doc") == F.col("node"), "left").select("key", "doc", F.coalesce("component", "doc").alias("c"))
    labelled = tables.write(labelled, "labelled")
    spread = labelled.groupBy("key").agg(F.min("c").alias("c_low"), F.max("c").alias("c_high")).where("c_low < c_high").select(F.col("key").alias("mixed"))
    return tables.write(labelled.join(spread, F.col("key") == F.col("mixed"), "left_semi"), "mixed")


def representatives(docs: DataFrame, k: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one document of each component, its least; documents without shingles all stay.

    Rows that repeat the id of a document that stays are rows of that document, and stay.
    """
    later = near_duplicates(docs, k, percent, doc_id, text).where(F.col(doc_id) != F.col("component_id")).select(F.col(doc_id).alias("later_")).distinct()
    return docs.join(later, docs[doc_id].eqNullSafe(later["later_"]), "left_anti")
