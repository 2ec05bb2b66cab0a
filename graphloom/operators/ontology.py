"""Ontology lookup, repair of categories and relations by a schema, and validity of relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.text import cross_reference, normalize_term
from graphloom.operators.graph import closure
from graphloom.operators.similar import similar
from graphloom.operators.steps import cut

#: Fixed value: similarity from which a name is taken for another.
CUTOFF = 80


def name_index(entries: DataFrame) -> DataFrame:
    """(name, id): lower-cased names and synonyms of entries (id, name, synonyms, ordinal); the last one that is written wins, synonyms after names."""
    named = F.filter(F.concat(F.array("name"), F.coalesce("synonyms", F.array().cast("array<string>"))), lambda n: n.isNotNull())
    each = entries.select("id", "ordinal", F.posexplode(named).alias("place", "label"))
    return each.groupBy(F.lower("label").alias("name")).agg(F.max_by("id", F.struct("ordinal", "place")).alias("id"))


def lookup(terms: DataFrame, index: DataFrame, term: str = "term") -> DataFrame:
    """``terms`` with the ontology's id of their name, null where it has none."""
    return terms.join(index.select(F.col("name").alias("indexed"), F.col("id").alias("ontology_id")), normalize_term(F.col(term)) == F.col("indexed"), "left").drop("indexed")


def repaired(values: DataFrame, names: DataFrame, column: str, cutoff: float = CUTOFF) -> DataFrame:
    """``values`` with ``fixed``: the schema name that ``column`` is, is but for case, or is most like; null without one.

    Only distinct values that no exact join settles are compared, and with those
    of the schema's names (name, pos) that share grams with them; ties go to the
    name that is written first.
    """
    clean = F.trim(F.coalesce(column, F.lit("")))
    distinct = values.select(clean.alias("asked")).distinct()
    lower = names.groupBy(F.lower("name").alias("lowered")).agg(F.max_by("name", "pos").alias("by_case"), F.min("pos").alias("pos"))
    exact = distinct.join(names.select(F.col("name").alias("same")).distinct(), F.col("asked") == F.col("same"), "left").join(lower.drop("pos"), F.lower("asked") == F.col("lowered"), "left")
    exact = cut(exact.select("asked", F.coalesce("same", "by_case").alias("fixed")))
    open_ = exact.where("fixed is null and asked <> ''").select("asked", F.lower("asked").alias("asked_lower"))
    near = similar(open_.select("asked_lower"), lower.select("lowered"), cutoff / 100)
    pairs = open_.join(near, F.col("asked_lower") == F.col("left")).join(lower, F.col("right") == F.col("lowered"))
    fuzzy = pairs.groupBy("asked").agg(F.max_by("by_case", F.struct("score", -F.col("pos"))).alias("fuzzy"))
    both = exact.join(fuzzy, "asked", "left").select("asked", F.coalesce("fixed", "fuzzy").alias("fixed"))
    return values.withColumn("asked", clean).join(both, "asked", "left").drop("asked")


def repaired_relations(relations: DataFrame, slots: DataFrame) -> DataFrame:
    """Relations (relation, related_term, ...) with schema names and ``verified``; those called description or category go."""
    kept = relations.where(~F.lower(F.trim(F.coalesce("relation", F.lit("")))).isin("description", "category"))
    fixed = repaired(kept, slots, "relation")
    return fixed.withColumns({"relation": F.coalesce("fixed", F.trim("relation")), "related_term": F.trim("related_term"), "verified": F.col("fixed").isNotNull()}).drop("fixed")


def validity(relations: DataFrame, terms: DataFrame, classes: DataFrame, slots: DataFrame) -> DataFrame:
    """Relations (term, relation, related_term, verified) with ``target_category`` and ``verified`` lowered where the slot's domain or range forbids it.

    A range that is no class, such as string, forbids every known object. An
    object without a category is not judged.
    """
    category = terms.select(normalize_term(F.col("term")).alias("k"), F.col("category").alias("c"))
    subject = relations.join(category.withColumnsRenamed({"k": "sk", "c": "subject_category"}), normalize_term(F.col("term")) == F.col("sk"), "left")
    both = subject.join(category.withColumnsRenamed({"k": "ok", "c": "target_category"}), normalize_term(F.col("related_term")) == F.col("ok"), "left")
    slot = both.join(slots.select(F.col("name").alias("slot"), "domain", "range"), F.col("relation") == F.col("slot"), "left")
    up = closure(classes)

    def under(df: DataFrame, child: str, parent: str, to: str) -> DataFrame:
        line = up.select(F.col("name").alias(f"{to}_n"), F.col("ancestor").alias(f"{to}_a"))
        joined = df.join(line, (F.col(child) == F.col(f"{to}_n")) & (F.col(parent) == F.col(f"{to}_a")), "left")
        return joined.withColumn(to, F.col(parent).isNull() | (F.col(child) == F.col(parent)) | F.col(f"{to}_n").isNotNull()).drop(f"{to}_n", f"{to}_a")

    ok = under(under(slot, "subject_category", "domain", "in_domain"), "target_category", "range", "in_range")
    valid = F.col("slot").isNotNull() & F.coalesce("in_domain", F.lit(False)) & F.coalesce("in_range", F.lit(False))
    verified = F.when(F.col("target_category").isNull() | F.col("subject_category").isNull(), F.col("verified")).otherwise(F.col("verified") & valid)
    return ok.select("term", "relation", "related_term", "target_category", verified.alias("verified"))


def schema_text(names: DataFrame, title: str) -> DataFrame:
    """One row: the schema's names and descriptions in alphabetical order, for prompts; schemas are small."""
    line = F.concat(F.lit("- "), "name", F.lit(": "), F.coalesce("description", F.lit("")))
    return names.agg(F.concat(F.lit(f"{title}:\n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("name", line.alias("line")))), lambda s: s["line"]), "\n")).alias("schema_text"))


def by_source(references: DataFrame) -> DataFrame:
    """(id, xrefs map of db to list) from (id, xref); references without a colon go."""
    parts = references.select("id", cross_reference(F.col("xref")).alias("x")).where("x.db is not null")
    lists = parts.groupBy("id", "x.db").agg(F.array_sort(F.collect_list("x.ref")).alias("refs"))
    return lists.groupBy("id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("db", "refs")))).alias("xrefs"))


def edges_by_kind(edges: DataFrame) -> DataFrame:
    """(id, roles, parents, others) from edges (source, predicate, target)."""
    of = lambda kind: F.array_sort(F.collect_list(F.when(kind, F.col("target"))))
    p: Column = F.col("predicate")
    rest = F.array_sort(F.collect_list(F.when(~p.isin("has_role", "is_a"), F.concat(p, F.lit("="), "target"))))
    return edges.groupBy(F.col("source").alias("id")).agg(of(p == "has_role").alias("roles"), of(p == "is_a").alias("parents"), rest.alias("others"))
