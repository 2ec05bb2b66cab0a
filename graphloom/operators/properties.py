"""Physical properties mined from sentences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.expressions import let
from graphloom.functions.text import sentences

#: Phrases and the properties they name.
KEYWORDS = {
    "band gap": "band_gap",
    "band-gap": "band_gap",
    "melting point": "melting_point",
    "melting_temperature": "melting_point",
    "glass transition temperature": "glass_transition_temperature",
    "t_g": "glass_transition_temperature",
    "conductivity": "conductivity",
    "electrical conductivity": "conductivity",
    "mobility": "mobility",
    "efficiency": "efficiency",
    "thermal conductivity": "thermal_conductivity",
    "dielectric constant": "dielectric_constant",
    "density": "density",
    "formation energy": "formation_energy",
    "formation energy per atom": "formation_energy",
    "bulk modulus": "bulk_modulus",
    "shear modulus": "shear_modulus",
    "elastic modulus": "bulk_modulus",
    "magnetic moment": "magnetic_moment",
    "energy above hull": "energy_above_hull",
}
#: Fixed value: number, uncertainty, unit.
VALUE_UNIT = r"([+-]?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)(?:\s*±\s*(\d+(?:\.\d+)?))?\s*(°[CF]|[A-Za-zµμ/°\^\-0-9]+)"
NEAR = 30


def _starts(text, phrase):
    """Starts of all occurrences, from the lengths of the pieces between them; the text is split once."""
    pieces = F.split(text, F.concat(F.lit(r"\Q"), phrase, F.lit(r"\E")), F.lit(-1))
    none = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("all"))
    step = lambda a, p: F.struct((a["at"] + F.length(p) + F.length(phrase)).alias("at"), F.concat(a["all"], F.array(a["at"] + F.length(p))).alias("all"))
    return let(F.aggregate(pieces, none, step, lambda a: a["all"]), lambda ends: F.slice(ends, 1, F.size(ends) - 1))


def mine(pages: DataFrame, materials: DataFrame) -> DataFrame:
    """Values of properties of materials, from pages (page_id, text) and materials (page_id, material).

    Materials meet pages by key; sentences without a phrase are dropped by one
    pattern before any of the costlier tests. A sentence without a number gives one row
    without a value.
    """
    phrases = F.broadcast(pages.sparkSession.createDataFrame(list(KEYWORDS.items()), "phrase string, property string"))
    cut = pages.select("page_id", F.posexplode(sentences(F.col("text"))).alias("no", "sentence")).withColumn("low", F.lower("sentence")).where(F.col("low").rlike("|".join(KEYWORDS)))
    # Small files are few tasks, so sentences are dealt anew before the costly part.
    said = cut.repartition("page_id").join(phrases, F.contains("low", F.col("phrase")))
    both = said.join(materials, "page_id").withColumn("m", F.lower("material"))
    near = let(_starts(F.col("low"), F.col("phrase")), lambda ys: F.exists(_starts(F.col("low"), F.col("m")), lambda x: F.exists(ys, lambda y: F.abs(x - y) <= NEAR)))
    p, m = (F.concat(F.lit(r"\b\Q"), F.col(c), F.lit(r"\E\b")) for c in ("phrase", "m"))
    of = F.regexp_like("low", F.concat(p, F.lit(r"\s+of\s+"), m))
    has = F.regexp_like("low", F.concat(m, F.lit(r"\s+.*?"), p))
    # A case, so that no plan runs the costly tests on a pair that a search for both words rules out.
    both = both.where(F.when(F.contains("low", F.col("phrase")) & F.contains("low", F.col("m")), (of | has) & near).otherwise(False))
    groups = [F.regexp_extract_all("sentence", F.lit(VALUE_UNIT), F.lit(g)) for g in (1, 2, 3)]
    found = both.select("page_id", "no", "material", "property", F.trim("sentence").alias("context"), F.explode_outer(F.arrays_zip(*(g.alias(n) for g, n in zip(groups, ("v", "s", "u"), strict=True)))).alias("hit"))
    return found.select(
        "page_id",
        "no",
        "material",
        "property",
        F.col("hit")["v"].alias("raw_value"),
        F.col("hit")["u"].alias("raw_unit"),
        F.nullif(F.col("hit")["s"], F.lit("")).alias("uncertainty"),
        "context",
        F.col("hit").isNotNull().alias("verified"),
    )


def from_relations(terms: DataFrame) -> DataFrame:
    """Rows without a value, of the measured_property relations of terms (term, relations); a null name counts as empty."""
    strip = lambda c: F.regexp_replace(c, r"^\s+|\s+\z", "")
    said = terms.select(strip(F.coalesce("term", F.lit(""))).alias("material"), F.inline("relations")).where("relation = 'measured_property'")
    name = F.coalesce("related_term", F.lit(""))
    known = F.create_map(*(F.lit(x) for pair in KEYWORDS.items() for x in pair))
    none = F.lit(None).cast("string")
    return said.withColumn("raw", F.lower(strip(name))).select(
        "material",
        F.coalesce(F.try_element_at(known, F.col("raw")), F.replace("raw", F.lit(" "), F.lit("_"))).alias("property"),
        none.alias("raw_value"),
        none.alias("raw_unit"),
        none.alias("uncertainty"),
        F.concat(F.lit("measured_property:"), name).alias("context"),
        F.coalesce("verified", F.lit(False)).alias("verified"),
    )
