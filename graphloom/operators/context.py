"""The context of an answer: facts about the ranked nodes, then a section for each, up to a budget of characters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.text import hinted_snippet, local_name, triple_text
from graphloom.operators.steps import cut, small

#: Triples, papers a node, characters of a paper's snippet and of the context.
TRIPLES, PAPERS, SNIPPET, BUDGET = 150, 3, 1000, 12_000
#: What the second line of each section starts with, so no section is shorter.
SCORE = "Combined_Score: "


def first_ranked(ranked: DataFrame, most: int) -> DataFrame:
    """The rows of each question with fewer than ``most`` rows of lesser rank, ties included; tasks count before rows meet, so few of them do."""
    order = Window.partitionBy("question_id").orderBy("rank")
    return ranked.withColumn("at_", F.rank().over(order)).where(F.col("at_") <= most).drop("at_")


def _named(out: DataFrame, names: DataFrame) -> DataFrame:
    """Edges ``out``, of few nodes, with ``to_name``, the name of their object; of ``names`` only those that they touch are shuffled."""
    out = cut(out)
    asked = cut(out.select(F.col("object").alias("to")).distinct())
    near = names.select(F.col("id").alias("to"), F.col("name").alias("to_name")).join(small(asked), "to", "left_semi")
    return out.join(near, F.col("object") == F.col("to"), "left")


def facts(ranked: DataFrame, edges: DataFrame, names: DataFrame, most: int = TRIPLES) -> DataFrame:
    """(question_id, n, triple): the first ``most`` out-edges of ranked nodes (question_id, rank, id, name), by rank and edge."""
    # Each node with an edge gives a fact at least, so the first ``most`` of these have all that are wanted.
    sources = edges.select(F.col("subject").alias("id")).distinct()
    near = small(cut(first_ranked(ranked.select("question_id", "rank", "id", "name").join(sources, "id", "left_semi"), most)))
    order = Window.partitionBy("question_id").orderBy("rank", "predicate", "object")
    numbered = lambda rows: rows.withColumn("n", F.row_number().over(order)).where(F.col("n") <= most)
    out = numbered(edges.join(near, F.col("subject") == F.col("id"))).select("question_id", "rank", "name", "predicate", "object")
    row = numbered(_named(out, names))
    return row.select("question_id", "n", triple_text(F.col("name"), F.col("predicate"), F.coalesce("to_name", "object")).alias("triple"))


def sections(ranked: DataFrame, edges: DataFrame, names: DataFrame, papers: DataFrame, hints: list[str], snippet: int = SNIPPET) -> DataFrame:
    """(question_id, rank, section) of ranked nodes (question_id, rank, id, name, category, score_prp, description, formula, source_papers).

    Snippets come from the first papers of ``papers`` (paper, text); relations
    are in order of their predicates, then targets.
    """
    key = ["question_id", "rank"]
    asked = cut(ranked.select(*key, F.posexplode(F.slice("source_papers", 1, PAPERS)).alias("place", "paper")))
    snip = papers.join(small(asked), "paper").withColumn("snip", hinted_snippet(F.coalesce("text", F.lit("")), snippet, hints)).where("snip <> ''")
    quoted = F.concat(F.lit("[PDF "), "paper", F.lit("]\n"), "snip")
    snips = snip.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("place", quoted.alias("line")))).alias("snips"))
    nodes = small(cut(ranked.select(*key, "id")))
    out = _named(edges.join(nodes, F.col("subject") == F.col("id")).select(*key, "predicate", "object"), names)
    line = F.concat(F.lit("- "), local_name(F.col("predicate")), F.lit(": "), F.coalesce("to_name", "object"))
    relations = out.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("predicate", "object", line.alias("line")))).alias("rels"))
    rows = ranked.join(snips, key, "left").join(relations, key, "left")
    lines = F.concat(
        F.array(F.concat(F.lit("## "), "name", F.lit(" ("), "category", F.lit(")")), F.format_string(f"{SCORE}%.3f", "score_prp")),
        F.when(F.coalesce("description", F.lit("")) != "", F.array(F.concat(F.lit("Description: "), "description"))).otherwise(F.array().cast("array<string>")),
        F.when(F.coalesce("formula", F.lit("")) != "", F.array(F.concat(F.lit("Formula: "), "formula"))).otherwise(F.array().cast("array<string>")),
        F.coalesce(F.transform("snips", lambda s: s["line"]), F.array().cast("array<string>")),
        F.coalesce(F.concat(F.array(F.lit("Relations:")), F.transform("rels", lambda r: r["line"])), F.array().cast("array<string>")),
    )
    return rows.select(*key, F.array_join(lines, "\n").alias("section"))


def assembled(ranked: DataFrame, edges: DataFrame, names: DataFrame, papers: DataFrame, hints: list[str], budget: int = BUDGET) -> DataFrame:
    """(question_id, context): the facts, then sections while what is before them is shorter than ``budget``; the first always stays.

    Sections are made of the ranks that can stay only: those before which fewer
    than ``budget`` characters fit, at the length that every section has at least.
    """
    listed = facts(ranked, edges, names).groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("n", "triple"))).alias("t"))
    block = F.concat(F.lit("Structured_KG_Facts:\n"), F.coalesce(F.array_join(F.transform("t", lambda x: x["triple"]), "\n"), F.lit("")))
    heads = ranked.select("question_id").distinct().join(listed, "question_id", "left").select("question_id", block.alias("head"))
    near = cut(first_ranked(ranked, max(budget, 0) // len(SCORE) + 1))
    parts = sections(near, edges, names, papers, hints).join(heads, "question_id")
    before = Window.partitionBy("question_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    first = F.min("rank").over(Window.partitionBy("question_id"))
    prior = F.length("head") + F.coalesce(F.sum(F.length("section")).over(before), F.lit(0))
    kept = parts.withColumns({"prior": prior, "first": first}).where((F.col("prior") < budget) | (F.col("rank") == F.col("first")))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "section"))), lambda s: s["section"]), "\n\n")
    return kept.groupBy("question_id", "head").agg(body.alias("body")).select("question_id", F.concat("head", F.lit("\n\n"), "body").alias("context"))


def without_evidence(ranked: DataFrame) -> DataFrame:
    """(question_id, none): whether no ranked node of a question has evidence; without a question column one row, true also where nothing is ranked."""
    none = F.coalesce(F.bool_and(F.col("evidence_ct") == 0), F.lit(True)).alias("none")
    return ranked.groupBy("question_id").agg(none) if "question_id" in ranked.columns else ranked.agg(none)
