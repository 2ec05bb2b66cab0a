"""Operator 5: line dedup by content-defined chunks, with SQL functions only.

Lines are hashed (32 bits of MD5), a rolling hash combines each line's hash
with those of the ``WINDOW`` - 1 lines before it, and a chunk ends where the
rolling hash is divisible by ``DIVISOR``, so chunks fall in step again soon
after an insertion. A chunk with at least ``LEAST_LINES`` lines that aren't
blank is removed wherever its bytes equal those of an earlier one: the first
place, by document id and position, keeps it.

Chunks meet by a 64-bit hash first; only the repeated ones' texts are then
shuffled and compared byte by byte, so a clash of hashes removes nothing.
Counts are combined before each shuffle, and joins on frequent chunks are
salted, so a chunk that a third of the documents hold is dealt over many tasks.
Texts meet their marks by merge joins at every size: both sides grow with the corpus.

Short passages seldom hold a whole chunk. ``dedup_passages`` removes repeated
chunks too, and compares each pair of neighbouring lines that no removed chunk
holds: those at the chunks' edges and in chunks that differ. Both are judged on
the text as it was given.

Null and empty texts have no such chunk and stay as they are. Null ids count as
the smallest id. Rows that repeat an id and text are one document: all of them
keep or lose the same lines. Extra columns are kept, whatever
their names; only n_lines_, n_removed_ and n_spans_ are replaced. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.arrays import let
from graphloom.llm.skew import hot_keys, salted_join
from graphloom.llm.store import Scratch, written

WINDOW, DIVISOR, LEAST_LINES = 3, 4, 2
#: Factors of the rolling hash, of the line itself and those before it.
FACTORS = [1, 31, 961]


def _line_hash(line: Column) -> Column:
    return F.conv(F.substring(F.md5(line.cast("binary")), 1, 8), 16, 10).cast("long")


def chunks(text: Column) -> Column:
    """Array of (no, n_lines, n_solid, body, start) of a text's chunks; their bodies joined by newlines are the text."""
    lines = F.split(F.coalesce(text, F.lit("")), "\n", -1)

    def ends(hashes: Column) -> Column:
        def rolled(i: Column) -> Column:
            total = F.get(hashes, i)
            for j in range(1, WINDOW):
                total = total + F.coalesce(F.get(hashes, i - j), F.lit(0)) * FACTORS[j]
            return total

        last = F.size(hashes) - 1
        return F.filter(F.sequence(F.lit(0), last), lambda i: (i == last) | (F.pmod(rolled(i), F.lit(DIVISOR)) == 0))

    def cut(rows: Column, at: Column) -> Column:
        def one(end: Column, j: Column) -> Column:
            start = F.when(j == 0, F.lit(0)).otherwise(F.get(at, j - 1) + 1)
            own = F.slice(rows, start + 1, end - start + 1)
            return F.struct(
                j.alias("no"),
                (end - start + 1).alias("n_lines"),
                F.size(F.filter(own, lambda x: x.rlike(r"\S"))).alias("n_solid"),
                F.array_join(own, "\n").alias("body"),
                start.alias("start"),
            )

        return F.transform(at, one)

    return let(lines, lambda rows: let(F.transform(rows, _line_hash), lambda hashes: let(ends(hashes), lambda at: cut(rows, at))))


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with ``text`` less its repeated chunks, and n_lines_, n_removed_ (lines) and n_spans_ (chunks) at the end."""
    key = F.coalesce(F.col(doc_id).cast("long"), F.lit(-(1 << 63)))
    # Other columns travel in a struct, so none of their names can clash with those made here.
    columns = [c for c in docs.columns if c not in ("n_lines_", "n_removed_", "n_spans_")]
    row = F.struct(*(F.col(c) for c in columns if c != text), F.lit(0).alias("filler_"))
    base = docs.select(row.alias("row_"), F.col(text).alias("text_"), key.alias("key_"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("text_hash_"))
    small = base.select("key_", "text_hash_", "text_")
    place = F.struct("key_", "text_hash_", "no")

    # The arrays of chunks are pinned by a generator, so no later step computes them again.
    many = small.where(F.instr("text_", "\n") > 0)
    every = many.select("key_", "text_hash_", F.inline(F.transform(chunks(F.col("text_")), lambda c: F.struct(c["no"].alias("no"), c["n_solid"].alias("n_solid"), F.xxhash64(c["body"]).alias("chunk")))))
    every = every.where(F.col("n_solid") >= LEAST_LINES).select("key_", "text_hash_", "no", "chunk")
    found = every.groupBy("chunk").agg(F.min(place).alias("first"), F.max(place).alias("last"), F.count("*").alias("copies"))
    tables = Scratch(docs.sparkSession)
    repeated = tables.write(found.where("first <> last").select("chunk", "first", "copies"), "repeated")
    hot = hot_keys(repeated, "chunk", "copies")
    flagged = salted_join(every, repeated.drop("copies"), "chunk", ["key_", "text_hash_", "no"], hot).select("key_", "text_hash_", F.struct("no", "chunk", (place == F.col("first")).alias("is_first")).alias("mark"))
    marks = flagged.groupBy(F.col("key_").alias("mark_key"), F.col("text_hash_").alias("mark_hash")).agg(F.collect_set("mark").alias("marks"))

    # Their bytes: one text a document id, so repeated rows are compared once.
    texts = small.join(marks.hint("merge"), (F.col("key_") == F.col("mark_key")) & (F.col("text_hash_") == F.col("mark_hash")))
    wanted = let(chunks(F.col("text_")), lambda all_: F.transform(F.col("marks"), lambda m: F.struct(m["chunk"].alias("chunk"), m["is_first"].alias("is_first"), m["no"].alias("no"), F.get(all_, m["no"])["n_lines"].alias("n_lines"), F.get(all_, m["no"])["body"].alias("body"))))
    bodies = texts.select("key_", "text_hash_", F.inline(wanted))
    bodies = tables.write(bodies, "bodies")
    firsts = bodies.where("is_first").groupBy("chunk").agg(F.min("body").alias("first_body"))
    equal = salted_join(bodies.where("not is_first"), firsts, "chunk", ["key_", "text_hash_", "no"], hot).where(F.col("body") == F.col("first_body"))
    gone = equal.groupBy(F.col("key_").alias("gone_key"), F.col("text_hash_").alias("gone_hash")).agg(F.collect_set(F.struct("no", "n_lines")).alias("gone"))
    gone = written(gone, "gone")
    tables.drop("repeated", "bodies")

    out = base.join(gone.hint("merge"), (F.col("key_") == F.col("gone_key")) & (F.col("text_hash_") == F.col("gone_hash")), "left")
    numbers = F.transform("gone", lambda g: g["no"])
    rest = let(chunks(F.col("text_")), lambda all_: F.array_join(F.transform(F.array_except(F.transform(all_, lambda c: c["no"]), numbers), lambda no: F.get(all_, no)["body"]), "\n"))
    return out.select(
        *(F.when(F.col("gone").isNull(), F.col("text_")).otherwise(rest).alias(text) if c == text else F.col("row_")[c].alias(c) for c in columns),
        F.size(F.split(F.coalesce("text_", F.lit("")), "\n", -1)).cast("long").alias("n_lines_"),
        F.coalesce(F.aggregate("gone", F.lit(0).cast("long"), lambda a, g: a + g["n_lines"]), F.lit(0)).cast("long").alias("n_removed_"),
        F.greatest(F.size(F.coalesce("gone", F.array())), F.lit(0)).cast("long").alias("n_spans_"),
    )


def pairs(text: Column) -> Column:
    """Array of (start, end, body) of each line that isn't blank with the next such line."""

    def cut(rows: Column, solid: Column) -> Column:
        def one(j: Column) -> Column:
            start, end = F.get(solid, j), F.get(solid, j + 1)
            return F.struct(start.alias("start"), end.alias("end"), F.array_join(F.slice(rows, start + 1, end - start + 1), "\n").alias("body"))

        return F.when(F.size(solid) > 1, F.transform(F.sequence(F.lit(0), F.greatest(F.size(solid) - 2, F.lit(0))), one))

    lines = F.split(F.coalesce(text, F.lit("")), "\n", -1)
    return let(lines, lambda rows: let(F.filter(F.sequence(F.lit(0), F.size(rows) - 1), lambda i: F.get(rows, i).rlike(r"\S")), lambda solid: cut(rows, solid)))


def units(text: Column) -> Column:
    """Array of (start, end, no, unit, wide) of a text's chunks of LEAST_LINES (wide) and its pairs; null without a pair.

    ``unit`` is a hash of the bytes, ``no`` the number of the chunk, which for a pair is the one that holds both lines, or null.
    """

    def both(cut: Column, of: Column) -> Column:
        def chunk(c: Column) -> Column:
            return F.struct(c["start"].alias("start"), (c["start"] + c["n_lines"] - 1).alias("end"), c["no"].alias("no"), F.xxhash64(c["body"], F.lit(True)).alias("unit"), F.lit(True).alias("wide"))

        def pair(p: Column) -> Column:
            no = F.get(of, p["start"])
            return F.struct(p["start"].alias("start"), p["end"].alias("end"), F.when(no == F.get(of, p["end"]), no).alias("no"), F.xxhash64(p["body"]).alias("unit"), F.lit(False).alias("wide"))

        return F.concat(F.transform(F.filter(cut, lambda c: c["n_solid"] >= LEAST_LINES), chunk), F.transform(pairs(text), pair))

    return let(chunks(text), lambda cut: let(F.flatten(F.transform(cut, lambda c: F.array_repeat(c["no"], c["n_lines"]))), lambda of: both(cut, of)))


def _repeated(found: DataFrame, tables: Scratch, name: str) -> tuple[DataFrame, DataFrame | None]:
    """The units that stand at two or more places, with is_first, as a table of that name; and the hot ones."""
    place = F.struct("key_", "text_hash_", "start")
    places = found.groupBy("unit").agg(F.min(place).alias("first"), F.max(place).alias("last"), F.count("*").alias("copies"))
    repeated = tables.write(places.where("first <> last").select("unit", "first", "copies"), "repeated")
    hot = hot_keys(repeated, "unit", "copies")
    hot = hot if hot is None else tables.write(hot, f"{name}_hot")
    marked = salted_join(found, repeated.drop("copies"), "unit", ["key_", "text_hash_", "start"], hot)
    marked = tables.write(marked.select("key_", "text_hash_", "start", "end", "no", "unit", (place == F.col("first")).alias("is_first")), name)
    tables.drop("repeated")
    return marked, hot


def dedup_passages(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with ``text`` less every passage of two or more lines that stands at an earlier place, and n_removed_ (lines) at the end.

    A chunk, as ``dedup`` cuts them, goes where its bytes equal those of an
    earlier chunk, and a pair of neighbouring lines where they equal those of an
    earlier pair, by document id and position in the given text. Pairs inside a
    chunk that repeats an earlier one aren't compared: they have gone, and each
    of them stands in that earlier chunk. Whatever line goes stands at an
    earlier place, so one copy stays; a chunk takes blank lines at its ends along.
    """
    key = F.coalesce(F.col(doc_id).cast("long"), F.lit(-(1 << 63)))
    columns = [c for c in docs.columns if c != "n_removed_"]
    row = F.struct(*(F.col(c) for c in columns if c != text), F.lit(0).alias("filler_"))
    base = docs.select(row.alias("row_"), F.col(text).alias("text_"), key.alias("key_"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("text_hash_"))
    small = base.select("key_", "text_hash_", "text_")

    tables = Scratch(docs.sparkSession)
    every = tables.write(small.where(F.instr("text_", "\n") > 0).select("key_", "text_hash_", F.inline(units(F.col("text_")))), "units")
    wide, hot_wide = _repeated(every.where("wide").drop("wide"), tables, "wide")
    # Pairs that no later copy of a chunk holds.
    later = wide.where("not is_first").select("key_", "text_hash_", "no").distinct()
    left = tables.write(every.where("not wide").drop("wide").join(later, ["key_", "text_hash_", "no"], "left_anti"), "pairs")
    tables.drop("units")
    narrow, hot_narrow = _repeated(left, tables, "narrow")
    tables.drop("pairs")
    found = [h for h in (hot_wide, hot_narrow) if h is not None]
    hot = found[0].union(found[1]) if len(found) > 1 else found[0] if found else None

    mark = F.struct("start", "end", "unit", "is_first")
    marks = wide.unionByName(narrow).groupBy(F.col("key_").alias("mark_key"), F.col("text_hash_").alias("mark_hash")).agg(F.collect_set(mark).alias("marks"))
    texts = small.join(marks.hint("merge"), (F.col("key_") == F.col("mark_key")) & (F.col("text_hash_") == F.col("mark_hash"))).dropDuplicates(["key_", "text_hash_"])
    body = lambda rows, m: F.array_join(F.slice(rows, m["start"] + 1, m["end"] - m["start"] + 1), "\n")
    wanted = let(F.split("text_", "\n", -1), lambda rows: F.transform("marks", lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), m["unit"].alias("unit"), m["is_first"].alias("is_first"), body(rows, m).alias("body"))))
    bodies = tables.write(texts.select("key_", "text_hash_", F.inline(wanted)), "bodies")
    tables.drop("wide", "narrow")
    firsts = bodies.where("is_first").groupBy("unit").agg(F.min("body").alias("first_body"))
    equal = salted_join(bodies.where("not is_first"), firsts, "unit", ["key_", "text_hash_", "start"], hot).where(F.col("body") == F.col("first_body"))
    gone = equal.groupBy(F.col("key_").alias("gone_key"), F.col("text_hash_").alias("gone_hash")).agg(F.flatten(F.collect_set(F.sequence("start", "end"))).alias("gone"))
    gone = written(gone, "gone")
    tables.drop("bodies", "wide_hot", "narrow_hot")

    out = base.join(gone.hint("merge"), (F.col("key_") == F.col("gone_key")) & (F.col("text_hash_") == F.col("gone_hash")), "left")
    lines = F.split(F.coalesce("text_", F.lit("")), "\n", -1)
    rest = let(lines, lambda rows: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(rows) - 1), F.col("gone")), lambda i: F.get(rows, i)), "\n"))
    return out.select(
        *(F.when(F.col("gone").isNull(), F.col("text_")).otherwise(rest).alias(text) if c == text else F.col("row_")[c].alias(c) for c in columns),
        F.coalesce(F.size(F.array_distinct("gone")), F.lit(0)).cast("long").alias("n_removed_"),
    )
