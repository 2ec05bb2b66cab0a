"""Structure and growth of graphs by (model, papers)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RUN = ["model", "papers"]


def structure(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """Counts and ratios of each run; entities (model, papers, id), relations (model, papers, subject, predicate, object)."""
    e = entities.distinct()
    r = relations.distinct()
    counts = e.groupBy(*RUN).agg(F.count("*").alias("entities"))
    edges = r.groupBy(*RUN).agg(F.count("*").alias("relations"), F.count_distinct("predicate").alias("unique_predicates"))
    ends = r.select(*RUN, F.explode(F.array("subject", "object")).alias("id")).distinct()
    touched = e.join(ends, [*RUN, "id"], "left_semi").groupBy(*RUN).agg(F.count("*").alias("touched"))
    rows = counts.join(edges, RUN, "left").join(touched, RUN, "left").na.fill(0)
    n = F.col("entities")
    return rows.select(
        *RUN,
        "entities",
        "relations",
        F.round(F.col("relations") / n, 2).alias("entity_relation_ratio"),
        F.round(100 * F.col("touched") / n, 1).alias("entities_with_relations_pct"),
        F.round(2 * F.col("relations") / n, 2).alias("avg_relations_per_entity"),
        "unique_predicates",
        F.round(n / F.col("papers"), 1).alias("entities_per_paper"),
        F.round(F.col("relations") / F.col("papers"), 1).alias("relations_per_paper"),
    )


def growth(entities: DataFrame) -> DataFrame:
    """Retention (%) and new entities per added paper against the model's run before; null for its first."""
    e = entities.distinct()
    runs = e.select(*RUN).distinct()
    before = runs.withColumn("earlier", F.lag("papers").over(Window.partitionBy("model").orderBy("papers")))
    # Each entity is shifted to the run after its own; one equi-join then finds what stayed.
    after = before.where("earlier is not null").select("model", "papers", "earlier")
    old = e.select("model", F.col("papers").alias("earlier"), "id").join(after, ["model", "earlier"]).select("model", "papers", "id", F.lit(1).alias("old"))
    new = e.withColumn("new", F.lit(1))
    sides = new.join(old, ["model", "papers", "id"], "full_outer").groupBy("model", "papers").agg(F.count("old").alias("n_old"), F.count("new").alias("n_new"), F.count_if(F.col("old").isNotNull() & F.col("new").isNotNull()).alias("stayed"))
    rows = before.join(sides, RUN)
    first = F.col("earlier").isNull()
    return rows.select(
        *RUN,
        F.when(~first, F.round(100 * F.col("stayed") / F.col("n_old"), 1)).alias("entity_retention"),
        (F.col("n_new") - F.col("stayed")).alias("new_entities"),
        F.when(~first, F.round((F.col("n_new") - F.col("stayed")) / (F.col("papers") - F.col("earlier")), 2)).alias("entity_growth_rate"),
    )
