"""What follows from triples by the traits of their slots: super-slots, inverse, symmetric and transitive slots, and classes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators.graph import closure
from graphloom.operators.steps import cut, small

#: Facts of a node on one side that a task should get.
PER_TASK = 10_000
#: The predicate that gives a thing its class.
TYPE = "type"
#: Slot, super-slot, domain, range, inverse, traits (s: symmetric, t: transitive).
CATALOGUE = [
    ("related_to", None, "NamedThing", "NamedThing", None, ""),
    ("physically_related_to", "related_to", None, None, None, ""),
    ("informationally_related_to", "related_to", None, None, None, ""),
    ("derives_from", "related_to", None, None, "has_derivative", ""),
    ("interacts_with", "physically_related_to", None, None, None, "s"),
    ("affects", "related_to", None, None, "affected_by", ""),
    ("has_property", "related_to", "Material", "Property", "is_property_of", ""),
    ("is_property_of", "related_to", "Property", "Material", "has_property", ""),
    ("has_structure", "physically_related_to", "Material", "Structure", "is_structure_of", ""),
    ("is_structure_of", "physically_related_to", "Structure", "Material", "has_structure", ""),
    ("processed_by", "physically_related_to", "Material", "Method", "processes", ""),
    ("processes", "physically_related_to", "Method", "Material", "processed_by", ""),
    ("used_in", "related_to", "Material", "Application", "uses", ""),
    ("uses", "related_to", "Application", "Material", "used_in", ""),
    ("characterizes", "informationally_related_to", "Method", "Property", "characterized_by", ""),
    ("characterized_by", "informationally_related_to", "Property", "Method", "characterizes", ""),
    ("modifies", "affects", "Method", "Property", "modified_by", ""),
    ("modified_by", "affects", "Property", "Method", "modifies", ""),
    ("requires_instrument", "related_to", "Method", "Instrument", "used_by_method", ""),
    ("used_by_method", "related_to", "Instrument", "Method", "requires_instrument", ""),
    ("has_component", "physically_related_to", "Structure", "Structure", "part_of", "t"),
    ("part_of", "physically_related_to", "Structure", "Structure", "has_component", "t"),
    ("forms_composite_with", "interacts_with", "Material", "Material", None, "s"),
    ("chemically_reacts_with", "interacts_with", "Material", "Material", None, "s"),
    ("dissolves_in", "interacts_with", "Material", "Material", "dissolves", ""),
    ("dissolves", "interacts_with", "Material", "Material", "dissolves_in", ""),
    ("correlates_with", "informationally_related_to", "Property", "Property", None, "s"),
    ("increases", "affects", "Property", "Property", "increased_by", ""),
    ("increased_by", "affects", "Property", "Property", "increases", ""),
    ("decreases", "affects", "Property", "Property", "decreased_by", ""),
    ("decreased_by", "affects", "Property", "Property", "decreases", ""),
    ("has_value", None, "Property", "xsd:float", None, ""),
    ("has_unit", None, "Property", "xsd:string", None, ""),
    ("has_description", None, "NamedThing", "xsd:string", None, ""),
    ("has_formula", None, "Material", "xsd:string", None, ""),
]


def catalogue(spark: SparkSession) -> DataFrame:
    """(slot, is_a, domain, range, inverse, symmetric, transitive)."""
    rows = [(*row[:5], "s" in row[5], "t" in row[5]) for row in CATALOGUE]
    return spark.createDataFrame(rows, "slot string, is_a string, domain string, range string, inverse string, symmetric boolean, transitive boolean")


def moves(slots: DataFrame) -> DataFrame:
    """(slot, to, flipped): each slot's other names for one fact, itself included; flipped ones have subject and object exchanged.

    A closure over (slot, flipped), written as ``slot`` and ``slot<`` so that
    it is one of a class table's.
    """
    at = lambda name, flipped: F.concat(F.coalesce(name, F.lit("")), F.lit("<") if flipped else F.lit(""))
    steps = []
    for flipped in (False, True):
        steps += [
            slots.select(at(F.col("slot"), flipped).alias("name"), at(F.col("is_a"), flipped).alias("is_a")).where("is_a not in ('', '<')"),
            slots.where("inverse is not null").select(at(F.col("slot"), flipped).alias("name"), at(F.col("inverse"), not flipped).alias("is_a")),
            slots.where("inverse is not null").select(at(F.col("inverse"), flipped).alias("name"), at(F.col("slot"), not flipped).alias("is_a")),
            slots.where("symmetric").select(at(F.col("slot"), flipped).alias("name"), at(F.col("slot"), not flipped).alias("is_a")),
        ]
    every = slots.select(F.col("slot").alias("name"), F.lit(None).cast("string").alias("is_a"))
    for step in steps:
        every = every.union(step)
    found = closure(every.distinct()).where("not name like '%<'")
    return found.select(F.col("name").alias("slot"), F.regexp_replace("ancestor", "<$", "").alias("to"), F.col("ancestor").endswith("<").alias("flipped")).distinct()


def chained(left: DataFrame, right: DataFrame) -> DataFrame:
    """(s, p, o): ends of two facts of one predicate that meet in a node.

    A node with more than PER_TASK facts on a side has these dealt over salts,
    and meets the other side's once a salt, so no task gets all of a node.
    """
    at = left.groupBy(F.col("p").alias("hub_p"), F.col("o").alias("hub")).agg(F.ceil(F.count("*") / PER_TASK).alias("lefts"))
    of = right.groupBy(F.col("p").alias("hub_p"), F.col("s").alias("hub")).agg(F.ceil(F.count("*") / PER_TASK).alias("rights"))
    hubs = cut(at.join(of, ["hub_p", "hub"]).where("lefts > 1 or rights > 1"))
    one = F.lit(1).cast("long")
    lefts, rights = F.coalesce("lefts", one), F.coalesce("rights", one)
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    few = small(hubs)
    before = left.join(few, (F.col("p") == F.col("hub_p")) & (F.col("o") == F.col("hub")), "left")
    before = before.select("s", "p", "o", F.pmod(F.xxhash64("s"), lefts).alias("left_salt"), every(rights).alias("right_salt"))
    after = right.join(few, (F.col("p") == F.col("hub_p")) & (F.col("s") == F.col("hub")), "left")
    after = after.select(F.col("s").alias("o"), "p", F.col("o").alias("end"), every(lefts).alias("left_salt"), F.pmod(F.xxhash64("o"), rights).alias("right_salt"))
    return before.join(after, ["o", "p", "left_salt", "right_salt"]).select("s", "p", F.col("end").alias("o"))


def infer(triples: DataFrame, slots: DataFrame, classes: DataFrame | None = None) -> DataFrame:
    """(s, p, o): the triples and all that follow from them.

    The rules with one premise (super-slot, inverse, symmetric) are closed once
    over the slots, which are few, and applied by one join. The transitive rule
    runs semi-naively: a round joins new facts with all on either side, so
    nothing is derived from old facts twice, and paths double in length. With
    ``classes`` (name, is_a), things have their class's ancestors as well.
    Triples with a null are left out. Predicates that are no slots are kept.
    """
    known = cut(moves(slots))
    transitive = cut(slots.where("transitive").select(F.col("slot").alias("p")).distinct())

    def renamed(facts: DataFrame) -> DataFrame:
        to = small(known)
        met = facts.join(to, F.col("p") == F.col("slot"), "left")
        swap = F.coalesce("flipped", F.lit(False))
        return met.select(F.when(swap, F.col("o")).otherwise(F.col("s")).alias("s"), F.coalesce("to", "p").alias("p"), F.when(swap, F.col("s")).otherwise(F.col("o")).alias("o")).distinct()

    every = cut(renamed(triples.where("s is not null and p is not null and o is not null").select("s", "p", "o")))
    only = lambda facts: facts.join(F.broadcast(transitive), "p", "left_semi").select("s", "p", "o")
    new = every
    while True:
        fresh, old = only(new), only(every)
        step = chained(fresh, old).union(chained(old, fresh)).distinct()
        new = cut(renamed(step).join(every, ["s", "p", "o"], "left_anti"))
        if new.isEmpty():
            break
        every = cut(every.union(new))
    if classes is not None:
        up = cut(closure(classes).select("name", "ancestor"))
        above = every.where(F.col("p") == TYPE).join(up, F.col("o") == F.col("name")).select("s", "p", F.col("ancestor").alias("o"))
        every = every.union(above).distinct()
    return every
