"""Property graph: building, degrees, neighbourhoods, weighted search and closure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.similarity import partial_ratio_udf, token_sort_udf
from graphloom.functions.text import is_generic, make_id
from graphloom.operators.steps import cut, small


#: What a term's record brings to its node, with the empty value of a stub.
CONTENT = {
    "pages": "array<int>",
    "source_papers": "array<string>",
    "context_snippets": "array<struct<text string, source_paper string, page int>>",
    "formula": "string",
    "formula_validation": "struct<input string, canonical string, mp_hits int, status string, error string>",
    "properties": "array<struct<property string, value double, unit string, uncertainty double, context string, verified boolean>>",
}


def build(terms: DataFrame, relations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(things, associations) from terms (term, category, definition, ordinal) and relations (term, relation, related_term, evidence, ordinal).

    A node comes from its own record or from being a target, whichever is first.
    Columns of CONTENT are taken along where ``terms`` has them; lists are empty
    where they are null. ``evidence`` may be a text or a list, joined by "; ".
    """
    def filled(name: str, kind: str, own: bool) -> Column:
        empty = F.lit("") if kind == "string" else F.array().cast(kind) if kind.startswith("array") else F.lit(None).cast(kind)
        return (F.coalesce(F.col(name).cast(kind), empty) if own and name in terms.columns else empty).alias(name)

    content = {own: [filled(c, k, own) for c, k in CONTENT.items()] for own in (True, False)}
    name = F.coalesce(F.nullif("term", F.lit("")), *([F.nullif("name", F.lit(""))] if "name" in terms.columns else []), F.lit("UNKNOWN"))
    about = F.coalesce(F.nullif("definition", F.lit("")), F.lit("N/A")).alias("description")
    own = terms.select(make_id(name).alias("id"), F.struct(F.col("ordinal"), F.lit(0).alias("stub"), name.alias("name"), F.coalesce("category", F.lit("Unknown")).alias("category"), about, *content[True]).alias("event"))
    real = relations.where("coalesce(related_term, '') <> ''")
    target = F.struct(F.col("ordinal"), F.lit(1).alias("stub"), F.col("related_term").alias("name"), F.lit("Unknown").alias("category"), F.lit("").alias("description"), *content[False])
    stubs = real.select(make_id(F.col("related_term")).alias("id"), target.alias("event"))
    things = own.unionByName(stubs).groupBy("id").agg(F.min_by("event", F.struct("event.ordinal", "event.stub")).alias("e"))
    things = things.select("id", "e.name", "e.category", "e.description", *(f"e.{c}" for c in CONTENT if c in terms.columns))
    listed = relations.schema["evidence"].dataType.typeName() == "array"
    evidence = F.array_join("evidence", "; ") if listed else F.col("evidence")
    edges = real.select(
        make_id(F.col("term")).alias("subject"),
        F.concat(F.lit("rel:"), F.coalesce("relation", F.lit("RELATED_TO"))).alias("predicate"),
        make_id(F.col("related_term")).alias("object"),
        F.struct("ordinal", F.nullif(evidence, F.lit("")).alias("text")).alias("e"),
    )
    return things, edges.groupBy("subject", "predicate", "object").agg(F.min("e")["text"].alias("has_evidence"))


def degree(edges: DataFrame) -> DataFrame:
    """Undirected degree; a loop counts twice."""
    return edges.select(F.explode(F.array("subject", "object")).alias("id")).groupBy("id").count().withColumnRenamed("count", "degree")


def strong(edges: DataFrame, least: int = 2) -> DataFrame:
    """Edges of which both ends have ``least`` edges or more."""
    ids = degree(edges).where(F.col("degree") >= least).select("id")
    return edges.join(ids, F.col("subject") == F.col("id"), "left_semi").join(ids, F.col("object") == F.col("id"), "left_semi")


def k_hop(edges: DataFrame, seeds: DataFrame, hops: int = 4) -> DataFrame:
    """(id, depth) of the nodes that out-edges reach from ``seeds`` (id), seeds included; the edges and each hop are written once."""
    edges = cut(edges.select("subject", "object"))
    seen = cut(seeds.select("id", F.lit(0).alias("depth")).distinct())
    front = seen
    for depth in range(1, hops + 1):
        step = edges.join(small(front.select(F.col("id").alias("from"))), F.col("subject") == F.col("from")).select(F.col("object").alias("id")).distinct()
        front = cut(step.join(seen.select("id"), "id", "left_anti").withColumn("depth", F.lit(depth)))
        if front.isEmpty():
            break
        seen = cut(seen.unionByName(front))
    return seen


def touching(edges: DataFrame, front: DataFrame) -> DataFrame:
    """The edges that start at a written frontier (id). A semi-join on a grouping key goes below a ``distinct`` of the edges, so only what is touched is made distinct."""
    return edges.join(small(front.select(F.col("id").alias("from_"))), F.col("subject") == F.col("from_"), "left_semi")


def edge_weights(edges: DataFrame, names: DataFrame, *kept: str) -> DataFrame:
    """(subject, object, weight) and ``kept`` columns of all edges; predicates are compared once each, not once an edge."""
    predicates = edges.select(F.col("predicate").alias("p")).distinct()
    predicates = predicates.withColumn("fuzzy", partial_ratio_udf("p", F.lit("RELATED_TO")))
    base = F.when(F.col("predicate").endswith("RELATED_TO"), 1.2).otherwise(1.5)
    joined = edges.join(predicates, F.col("predicate") == F.col("p")).join(names.select(F.col("id").alias("to"), "name"), F.col("object") == F.col("to"), "left")
    damp = F.when(is_generic(F.coalesce("name", "object")), 0.8).otherwise(1.0)
    return joined.select("subject", "object", *kept, ((base + F.col("fuzzy") / 100) * damp).alias("weight"))


def weighted_search(edges: DataFrame, names: DataFrame, seeds: DataFrame, hops: int = 1) -> DataFrame:
    """(id, score, depth): the best score of each node; a hop multiplies by weight / (depth + 1).

    Only edges that a frontier touches are weighed. Each hop is written once.
    """
    order: Column = F.struct("score", (-F.col("depth")).alias("back"))
    best = cut(seeds.where("score > 0").select("id", "score", F.lit(0).alias("depth")))
    front = best
    for depth in range(hops):
        touched = touching(edges, front).join(small(front.select(F.col("id").alias("from"), "score")), F.col("subject") == F.col("from"))
        weighed = edge_weights(cut(touched), names, "score")
        step = weighed.groupBy(F.col("object").alias("id")).agg(F.max(F.col("score") * F.col("weight") / (depth + 1)).alias("score"))
        step = step.where("score > 0").withColumn("depth", F.lit(depth + 1))
        known = best.select(F.col("id").alias("known"), F.col("score").alias("known_score"))
        front = cut(step.join(known, F.col("id") == F.col("known"), "left").where("known is null or score > known_score").select("id", "score", "depth"))
        best = cut(best.unionByName(front).groupBy("id").agg(F.max(order).alias("b")).select("id", "b.score", (-F.col("b.back")).alias("depth")))
    return best


def closure(parents: DataFrame) -> DataFrame:
    """(name, ancestor) pairs of a class table (name, is_a), each class an ancestor of itself.

    Paths double in length each round, until nothing is new, so any depth is
    covered in a few rounds; cycles end as well.
    """
    up = parents.where("is_a is not null").select("name", F.col("is_a").alias("ancestor"))
    pairs = cut(parents.select("name", F.col("name").alias("ancestor")).union(up).distinct())
    before, now = 0, pairs.count()
    while now > before:
        on = pairs.select(F.col("name").alias("via"), F.col("ancestor").alias("top"))
        pairs = cut(pairs.join(on, F.col("ancestor") == F.col("via")).select("name", F.col("top").alias("ancestor")).distinct())
        before, now = now, pairs.count()
    return pairs


def groups(links: DataFrame) -> DataFrame:
    """(node, group) of the nodes of links (a, b): the least node that a chain of links reaches.

    Each round takes the least label among a node's neighbours and then that
    label's own label, so long chains are halved a round; rounds end when no
    label changes. Each is written once.
    """
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a is not null and b is not null").distinct()
    both = cut(both.union(both.select("a", F.col("a").alias("b"))).distinct())
    labels = cut(both.groupBy("a").agg(F.min("b").alias("label")).withColumnRenamed("a", "node"))
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("near"))
        of = labels.select(F.col("node").alias("via"), F.col("label").alias("further"))
        moved = near.join(of, F.col("near") == F.col("via")).select(F.col("a").alias("node"), F.least("near", "further").alias("label"))
        moved = cut(moved)
        changed = moved.join(labels.withColumnRenamed("label", "old"), "node").where("label <> old")
        if changed.isEmpty():
            return moved.withColumnRenamed("label", "group")
        labels = moved


def shortest_path(edges: DataFrame, source: str, target: str) -> DataFrame:
    """(path): one shortest undirected path as an array of ids, the least of those that a level-by-level search keeps; no row if there is none."""
    both = edges.select("subject", "object").union(edges.select(F.col("object").alias("subject"), F.col("subject").alias("object"))).where("subject <> object")
    both = cut(both)
    front = cut(edges.sparkSession.range(1).select(F.lit(source).alias("id"), F.array(F.lit(source)).alias("path")))
    seen = front.select("id")
    while not front.isEmpty():
        hit = front.where(F.col("id") == target)
        if not hit.isEmpty():
            return hit.select("path")
        step = both.join(small(front), F.col("subject") == F.col("id")).groupBy("object").agg(F.min("path").alias("path"))
        step = step.join(seen.withColumnRenamed("id", "seen_id"), F.col("object") == F.col("seen_id"), "left_anti")
        front = cut(step.select(F.col("object").alias("id"), F.concat("path", F.array("object")).alias("path")))
        seen = cut(seen.union(front.select("id")))
    return front.select("path")


def isolate(edges: DataFrame, center: str) -> DataFrame:
    """The edges among a node and its undirected neighbours."""
    ends = edges.where((F.col("subject") == center) | (F.col("object") == center)).select(F.explode(F.array("subject", "object")).alias("id"))
    near = cut(ends.union(edges.sparkSession.range(1).select(F.lit(center))).distinct())
    return edges.join(small(near), F.col("subject") == F.col("id"), "left_semi").join(small(near), F.col("object") == F.col("id"), "left_semi")


def additive_search(edges: DataFrame, seeds: DataFrame, hops: int = 3, least: float = 0.01, k: int = 12) -> DataFrame:
    """(id, score): the older search, whose hops add: score * weight + token_sort_ratio / (depth + 1); the best of all walks."""
    predicates = cut(edges.select(F.col("predicate").alias("p")).distinct()).withColumn("fuzzy", token_sort_udf("p", F.lit("RELATED_TO")) / 100)
    base = F.when(F.col("predicate").endswith("RELATED_TO"), 1.2).otherwise(1.5)
    front = best = cut(seeds.select("id", F.lit(1.0).alias("score")).distinct())
    for depth in range(hops):
        touched = edges.join(small(front), F.col("subject") == F.col("id")).join(predicates, F.col("predicate") == F.col("p"))
        step = touched.select(F.col("object").alias("id"), (F.col("score") * base + F.col("fuzzy") / (depth + 1)).alias("score")).where(F.col("score") >= least)
        front = cut(step.groupBy("id").agg(F.max("score").alias("score")))
        best = best.unionByName(front)
    return best.groupBy("id").agg(F.max("score").alias("score")).orderBy(F.desc("score"), "id").limit(k)
