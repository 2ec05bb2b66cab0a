"""Operator 4: exact removal of repeated byte strings by deep-shallow suffix sorting.

A byte is removed where a ``LENGTH``-byte string (50) that covers it also starts
in a document with a smaller id. Strings are judged on the input.

1. Each string has an anchor: the least hash of its ``GRAM``-byte grams. Equal
   strings have equal anchors, so strings whose anchor occurs in one document
   only are settled. Only anchors are shuffled for this, about one for 17 bytes.
2. Neighbouring strings of a document with one live anchor form a piece. Pieces
   meet by anchor and go, with their bytes, to suffix sorting in Python workers,
   as many whole groups at a time as fit a buffer.
3. Multikey quicksort and blind tries order the pieces of each group; equal
   ones stand together, and all but those of their smallest document are
   repeats as a whole. Then the suffixes of the different pieces of a group are
   sorted in the same way, to ``LENGTH`` bytes; of equal ones, those of later documents go.
   Bytes alone decide: hashes only bring together what may be equal.
4. Anchors of more than ``HOT`` documents are cut finer, by anchors of
   ``FINE``-byte grams, and dealt over as many salts as keep about HOT documents
   in each. The pieces that stay the first of their kind under a salt are
   sorted once more without it, a few for each different piece.

Anchors' least and greatest documents are combined before their shuffle. Lists
are by document and bounded by the document's own length.

Null texts are empty; empty and short texts lose nothing. Very long texts are
handled whole, one at a time. A null id counts as the smallest. Rows that
repeat an id don't count as earlier than each other; each is judged on its own.
Extra columns aren't read. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm import textvec as tv
from graphloom.llm.store import Scratch, written
from graphloom.llm.suffix_sort import equal_suffixes

LENGTH, GRAM, FINE = 50, 18, 36
#: Documents of an anchor from which its strings are cut finer and salted.
HOT = 1000
#: Passes over the live texts, each with its share of the keys, so that fewer pieces are in a shuffle at once.
PASSES = 2
#: Bytes of pieces that are sorted together.
BUFFER = 8 << 20
PIECE = "key long, salt int, doc long, same long, start int, n int, piece binary"


def _least(sums: np.ndarray, inverse: np.ndarray, gram: int) -> np.ndarray:
    """The least hash of the ``gram``-byte grams of the string at each position."""
    least = tv.mix((sums[gram:] - sums[:-gram]) * inverse[: len(sums) - gram])
    # Of a power of two by doubling, then of two such that overlap.
    width, every = 1, LENGTH - gram + 1
    while width * 2 <= every:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if every > width:
        least = np.minimum(least[: width - every], least[every - width :])
    return least


def _sums(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Running sums of hashed bytes by place, and the factors that take the place out again."""
    power, inverse = tv._tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, tv.U64)
    np.cumsum(tv.mix(np.arange(256, dtype=tv.U64) + tv.BASE)[data] * power[: len(data)], out=sums[1:])
    return sums, inverse


def anchors_of(data: np.ndarray, off: np.ndarray, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Place (in the buffer), document and anchor of each string that lies within a document."""
    if len(data) < LENGTH:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, tv.U64)
    least = _least(*_sums(data), gram)
    at = np.arange(len(least))
    doc = np.repeat(np.arange(len(off) - 1), np.diff(off))[: len(least)]
    inside = at + LENGTH <= off[doc + 1]
    return at[inside], doc[inside], least[inside]


def anchors(base: DataFrame) -> DataFrame:
    """(anchor, doc) of the strings of each row of ``base`` (doc, same, text_), each once."""
    tv.arrow_limits(base.sparkSession)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tv.rounds(batch, "text_"):
                _, doc, least = anchors_of(*tv.flat(part.column("text_")), GRAM)
                new = np.ones(len(doc), bool)
                new[1:] = (least[1:] != least[:-1]) | (doc[1:] != doc[:-1])
                doc, least = doc[new], least[new]
                order = np.lexsort((least, doc))
                doc, least = doc[order], least[order]
                new = np.ones(len(doc), bool)
                new[1:] = (least[1:] != least[:-1]) | (doc[1:] != doc[:-1])
                yield pa.RecordBatch.from_arrays([pa.array(least[new].view(np.int64)), part.column("doc").take(pa.array(doc[new]))], ["anchor", "doc"])

    return base.mapInArrow(emit, "anchor long, doc long")


def pieces(texts: DataFrame, turn: int) -> DataFrame:
    """The pieces of each row of ``texts`` (doc, same, text_, live): maximal runs of strings with one live anchor, hot ones cut by finer anchors.

    Only those whose key falls to this turn of PASSES.
    """
    tv.arrow_limits(texts.sparkSession)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tv.rounds(batch, "text_"):
                data, off = tv.flat(part.column("text_"))
                at, doc, least = anchors_of(data, off, GRAM)
                key, salt, wanted = least.view(np.int64).copy(), np.full(len(at), -1, np.int32), np.zeros(len(at), bool)
                cuts = np.searchsorted(doc, np.arange(len(part) + 1))
                for i in range(len(part)):
                    own = slice(cuts[i], cuts[i + 1])
                    live = part.column("live")[i].values
                    known, salts = live.field("anchor").to_numpy(), live.field("salt").to_numpy()
                    order = np.argsort(known)
                    place = order[np.minimum(np.searchsorted(known, key[own], sorter=order), len(known) - 1)]
                    wanted[own] = known[place] == key[own]
                    salt[own] = salts[place]
                hot = wanted & (salt >= 0)
                if hot.any():
                    key[hot] = _least(*_sums(data), FINE)[at[hot]].view(np.int64)
                wanted &= key.view(tv.U64) % tv.U64(PASSES) == turn
                at, doc, key, salt = at[wanted], doc[wanted], key[wanted], salt[wanted]
                new = np.ones(len(at), bool)
                new[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1]) | (at[1:] != at[:-1] + 1) | (salt[1:] != salt[:-1])
                first = np.flatnonzero(new)
                count = np.diff(np.append(first, len(at)))
                start, owner, raw = at[first], pa.array(doc[first]), data.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(key[first]),
                        pa.array(salt[first]),
                        part.column("doc").take(owner),
                        part.column("same").take(owner),
                        pa.array((start - off[doc[first]]).astype(np.int32)),
                        pa.array(count.astype(np.int32)),
                        pa.array([raw[s : s + c - 1 + LENGTH] for s, c in zip(start.tolist(), count.tolist(), strict=True)], pa.binary()),
                    ],
                    ["key", "salt", "doc", "same", "start", "n", "piece"],
                )

    return texts.mapInArrow(emit, PIECE)


def _ranges(flags: np.ndarray, owner: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Owner, first place and length of the maximal runs of set flags; places of an owner follow one another."""
    at = np.flatnonzero(flags)
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1] + 1) | (owner[at[1:]] != owner[at[:-1]])
    first = np.flatnonzero(new)
    return owner[at[first]], place[at[first]], np.diff(np.append(first, len(at)))


def judged(key: np.ndarray, doc: np.ndarray, n: np.ndarray, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of pieces in whole groups of ``key``: row, first place and count of strings that an earlier document has, and which rows stay the first of their kind."""
    rows = np.arange(len(key))
    kind = equal_suffixes(data, off[:-1], n.astype(np.int64) + LENGTH - 1, [key.view(tv.U64) ^ tv.U64(1 << 63), n.astype(tv.U64)])
    kinds = int(kind.max()) + 1
    low = np.full(kinds, np.iinfo(np.int64).max)
    np.minimum.at(low, kind, doc)
    later = doc > low[kind]
    whole = rows[later]
    # One row stands for each kind; kinds of a group with several are compared string by string.
    stand = np.full(kinds, -1)
    stand[kind[~later][::-1]] = rows[~later][::-1]
    group = key[stand]
    several = np.zeros(kinds, bool)
    order = np.argsort(group, kind="stable")
    same = group[order][1:] == group[order][:-1]
    several[order[1:][same]] = True
    several[order[:-1][same]] = True
    chosen = stand[several]
    owner = np.repeat(np.flatnonzero(several), n[chosen])
    place = np.arange(len(owner)) - np.repeat(np.cumsum(n[chosen]) - n[chosen], n[chosen])
    at = off[stand[owner]] + place
    string = equal_suffixes(data, at, np.full(len(at), LENGTH), [key[stand[owner]].view(tv.U64)], low[owner])
    first = np.full(int(string.max()) + 1 if len(string) else 0, np.iinfo(np.int64).max)
    np.minimum.at(first, string, low[owner])
    found, begin, count = _ranges(first[string] < low[owner], owner, place)
    # Each row of such a kind and of its first document loses these strings.
    kept = rows[~later]
    kept = kept[np.argsort(kind[kept], kind="stable")]
    a, b = np.searchsorted(kind[kept], found), np.searchsorted(kind[kept], found, "right")
    each = np.repeat(np.arange(len(found)), b - a)
    row = kept[np.arange(len(each)) - np.repeat(np.cumsum(b - a) - (b - a), b - a) + a[each]]
    return np.concatenate([whole, row]), np.concatenate([np.zeros(len(whole), np.int64), begin[each]]), np.concatenate([n[whole].astype(np.int64), count[each]]), ~later


def sorted_pieces(given: DataFrame) -> DataFrame:
    """Of ``given`` (PIECE): rows without a piece are ranges (start, n) to remove; of salted groups, rows with one are the first of their kind."""
    dealt = given.repartition("key", "salt").sortWithinPartitions("key", "salt")

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_groups(batches):
            data, off = tv.flat(table.column("piece"))
            key, salt, doc, n = (table.column(c).to_numpy() for c in ("key", "salt", "doc", "n"))
            row, begin, count, first = judged(key, doc, n, data, off)
            stay = np.flatnonzero(first & (salt >= 0))
            gone = table.take(pa.array(row))
            start = (gone.column("start").to_numpy() + begin).astype(np.int32)
            out = [*(gone.column(c) for c in ("key", "salt", "doc", "same")), pa.array(start), pa.array(count.astype(np.int32)), pa.nulls(len(row), pa.binary())]
            yield pa.RecordBatch.from_arrays(out, table.schema.names)
            if len(stay):
                yield table.take(pa.array(stay))

    return dealt.mapInArrow(emit, PIECE)


def _whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of about BUFFER bytes that hold whole groups of (key, salt); rows come in that order."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size < BUFFER:
            continue
        table = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        key, salt = table.column("key").to_numpy(), table.column("salt").to_numpy()
        cut = int(np.flatnonzero((key != key[-1]) | (salt != salt[-1]))[-1]) + 1 if (key[0], salt[0]) != (key[-1], salt[-1]) else 0
        if cut:
            yield table.slice(0, cut)
        held = [table.slice(cut)]
        size = BUFFER // 2 if cut else 0
    if held and sum(b.num_rows for b in held):
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def repeats(base: DataFrame, tables: Scratch) -> DataFrame:
    """(gone_doc, gone_same, gone): of each document, the ranges (start, n) of strings that an earlier one has."""
    every = tables.write(anchors(base), "anchors")
    ends = every.groupBy("anchor").agg(F.min("doc").alias("low"), F.max("doc").alias("high"), F.count("*").alias("docs")).where("low < high")
    salts = F.when(F.col("docs") > HOT, F.ceil(F.col("docs") / HOT).cast("long"))
    shared = tables.write(ends.select(F.col("anchor").alias("met"), salts.alias("salts")), "shared")
    salt = F.coalesce(F.pmod(F.xxhash64("doc"), F.col("salts")).cast("int"), F.lit(-1))
    live = every.join(shared, F.col("anchor") == F.col("met")).groupBy(F.col("doc").alias("live_doc")).agg(F.collect_set(F.struct("anchor", salt.alias("salt"))).alias("live"))
    live = tables.write(live, "live")
    tables.drop("anchors", "shared")
    texts = base.join(live, F.col("doc") == F.col("live_doc")).select("doc", "same", "text_", "live")
    turns = [tables.write(sorted_pieces(pieces(texts, turn)), f"once{turn}") for turn in range(PASSES)]
    once = reduce(DataFrame.unionByName, turns)
    tables.drop("live")
    again = sorted_pieces(once.where("piece is not null").withColumn("salt", F.lit(-1)))
    spans = once.where("piece is null").unionByName(again)
    gone = spans.groupBy(F.col("doc").alias("gone_doc"), F.col("same").alias("gone_same")).agg(F.collect_list(F.struct("start", "n")).alias("gone"))
    return written(gone, "gone")


def cut(text: bytes, starts: np.ndarray, counts: np.ndarray) -> tuple[bytes, int, int]:
    """What is left of a text, and how many bytes and maximal spans went."""
    edge = np.zeros(len(text) + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + counts - 1 + LENGTH, -1)
    gone = np.cumsum(edge[:-1]) > 0
    spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()) if len(text) else 0
    return np.frombuffer(text, np.uint8)[~gone].tobytes(), int(gone.sum()), spans


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, kept binary, n_bytes, n_removed, n_spans, kept_sha256) for each row of ``docs``."""
    key = F.coalesce(F.col(doc_id).cast("long"), F.lit(-(1 << 63)))
    given = docs.select(F.col(doc_id).cast("long").alias("id_"), key.alias("doc"), F.coalesce(text, F.lit("")).alias("text_"))
    given = given.withColumn("same", F.xxhash64("text_"))
    with Scratch(docs.sparkSession) as tables:
        gone = repeats(given.select("doc", "same", "text_"), tables)
    joined = given.join(gone, (F.col("doc") == F.col("gone_doc")) & (F.col("same") == F.col("gone_same")), "left").select("id_", "text_", "gone")
    tv.arrow_limits(docs.sparkSession)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tv.rounds(batch, "text_"):
                texts, marks = part.column("text_").to_pylist(), part.column("gone")
                rows = []
                for i, t in enumerate(texts):
                    raw = t.encode()
                    kept, removed, spans = raw, 0, 0
                    if marks[i].is_valid:
                        m = marks[i].values
                        kept, removed, spans = cut(raw, m.field("start").to_numpy().astype(np.int64), m.field("n").to_numpy().astype(np.int64))
                    rows.append((kept, len(raw), removed, spans, hashlib.sha256(kept).hexdigest()))
                kept, size, removed, spans, sha = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [part.column("id_"), pa.array(kept, pa.binary()), pa.array(size, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(sha, pa.string())],
                    [doc_id, "kept", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
                )

    return joined.mapInArrow(emit, f"`{doc_id}` long, kept binary, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
