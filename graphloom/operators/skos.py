"""A class hierarchy from SKOS triples (s, p, o), and its RDF triples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.text import class_id, label_or_tail, scheme_id
from graphloom.operators.steps import cut

#: The vocabulary, and the domain classes in the order in which they are tried.
RDF, RDFS, OWL, SKOS = "http://www.w3.org/1999/02/22-rdf-syntax-ns#", "http://www.w3.org/2000/01/rdf-schema#", "http://www.w3.org/2002/07/owl#", "http://www.w3.org/2004/02/skos/core#"
XSD = "http://www.w3.org/2001/XMLSchema#"
DOMAIN = ["NamedThing", "Material", "Property", "Structure", "Method", "Application", "Instrument"]
#: Pairs of classes that share no member.
DISJOINT = [
    ("Material", "Property"), ("Material", "Method"), ("Material", "Structure"), ("Material", "Application"), ("Property", "Method"),
    ("Property", "Structure"), ("Property", "Application"), ("Method", "Structure"), ("Method", "Application"), ("Structure", "Application"),
]
#: Classes that equal Material with values of these properties.
EQUIVALENT = [
    ("Polymer", "has_structure", "PolymerStructure"), ("Ceramic", "has_property", "Hardness"), ("Ceramic", "has_property", "BrittlenessToughness"),
    ("Semiconductor", "has_property", "ElectricalConductivity"), ("Semiconductor", "has_property", "BandGap"),
]


def nodes(triples: DataFrame) -> DataFrame:
    """(id, kind, label, definition, scheme) of schemes and concepts. A scheme's label is its rdfs:label, else its prefLabel; a concept's the other way round."""
    value = lambda *names: F.coalesce(*(F.min(F.when(F.col("p") == n, F.col("o"))) for n in names))
    made = triples.groupBy(F.col("s").alias("id")).agg(
        F.max(F.when((F.col("p") == f"{RDF}type") & F.col("o").isin(f"{SKOS}ConceptScheme", f"{SKOS}Concept"), F.substring_index("o", "#", -1))).alias("kind"),
        value(f"{SKOS}prefLabel", f"{RDFS}label").alias("concept_label"),
        value(f"{RDFS}label", f"{SKOS}prefLabel").alias("scheme_label"),
        value(f"{SKOS}definition").alias("definition"),
        value(f"{SKOS}inScheme").alias("scheme"),
    )
    label = F.when(F.col("kind") == "ConceptScheme", F.col("scheme_label")).otherwise(F.col("concept_label"))
    return made.where("kind is not null").select("id", "kind", label_or_tail(label, F.col("id")).alias("label"), "definition", "scheme")


def broader(triples: DataFrame) -> DataFrame:
    """(child, parent) among known nodes, from broader and inverted narrower."""
    up = triples.where(F.col("p") == f"{SKOS}broader").select(F.col("s").alias("child"), F.col("o").alias("parent"))
    down = triples.where(F.col("p") == f"{SKOS}narrower").select(F.col("o").alias("child"), F.col("s").alias("parent"))
    known = nodes(triples).select("id")
    return up.union(down).distinct().join(known, F.col("child") == F.col("id"), "left_semi").join(known, F.col("parent") == F.col("id"), "left_semi")


def _domain(label):
    """The first domain class whose name stands in a label, else null."""
    out = F.lit(None).cast("string")
    for name in reversed(DOMAIN):
        out = F.when(F.contains(F.lower(label), F.lit(name.lower())), name).otherwise(out)
    return out


def classes(triples: DataFrame, by_broader: bool = False) -> DataFrame:
    """(class, title, description, parent): a class a node; its parent is its scheme's class, else the domain class in its title, else Material.

    Of nodes that give one class the least id counts, since triples have no
    order. With ``by_broader``, the class of a concept's broader concept (the
    least of several) goes before Material.
    """
    every = nodes(triples)
    own = F.when(F.col("kind") == "ConceptScheme", F.coalesce(_domain(F.col("label")), scheme_id(F.col("label")))).otherwise(class_id(F.col("label")))
    named = every.withColumn("class", own)
    scheme = named.select(F.col("id").alias("scheme_id"), F.col("class").alias("scheme_class"))
    both = named.join(scheme, F.col("scheme") == F.col("scheme_id"), "left").where(~F.col("class").isin(DOMAIN))
    wider = F.lit(None).cast("string")
    if by_broader:
        up = broader(triples).join(named.select(F.col("id").alias("up_id"), F.col("class").alias("up_class")), F.col("parent") == F.col("up_id"))
        both = both.join(up.groupBy("child").agg(F.min("up_class").alias("wider")), F.col("id") == F.col("child"), "left")
        wider = F.when(F.col("wider") != F.col("class"), F.col("wider"))
    parent = F.coalesce("scheme_class", _domain(F.col("label")), wider, F.lit("Material"))
    return both.groupBy("class").agg(F.min(F.struct("id", F.col("label").alias("title"), F.coalesce("definition", F.lit("")).alias("description"), parent.alias("parent"))).alias("c")).select("class", "c.title", "c.description", "c.parent")


def class_triples(made: DataFrame, base: str = "urn:class:") -> DataFrame:
    """(s, p, o) of classes: type, label, comment, parent."""
    name = F.concat(F.lit(base), "class")
    triple = lambda p, o: F.struct(name.alias("s"), F.lit(p).alias("p"), o.alias("o"))
    every = F.array(
        triple(f"{RDF}type", F.lit(f"{OWL}Class")),
        triple(f"{RDFS}label", F.col("title")),
        triple(f"{RDFS}comment", F.nullif("description", F.lit(""))),
        triple(f"{RDFS}subClassOf", F.concat(F.lit(base), "parent")),
    )
    return made.select(F.inline(every)).where("o is not null")


def lists(items: DataFrame) -> DataFrame:
    """(s, p, o) of RDF lists, from (list, items): a chain of blank nodes, first and rest, of which the first is the list's own name; an empty list is rdf:nil."""
    node = lambda i: F.when(i == 0, F.col("list")).otherwise(F.concat("list", F.lit("_"), i.cast("string")))
    triple = lambda s, p, o: F.struct(s.alias("s"), F.lit(p).alias("p"), o.alias("o"))
    last = F.size("items") - 1
    links = F.transform("items", lambda x, i: F.array(triple(node(i), f"{RDF}first", x), triple(node(i), f"{RDF}rest", F.when(i == last, F.lit(f"{RDF}nil")).otherwise(node(i + 1)))))
    return items.where(F.size("items") > 0).select(F.inline(F.flatten(links)))


def read_lists(triples: DataFrame) -> DataFrame:
    """(list, place, item) of the RDF lists in triples, whatever their lengths.

    Each node points to the one before it, a first node to itself, and every
    round the pointers are followed once more, so a list of n items takes about
    log2(n) rounds. Lists that run in a circle raise an error.
    """
    first = triples.where(F.col("p") == f"{RDF}first").select(F.col("s").alias("node"), F.col("o").alias("item"))
    rest = triples.where((F.col("p") == f"{RDF}rest") & (F.col("o") != f"{RDF}nil")).select(F.col("o").alias("at"), F.col("s").alias("before"))
    linked = first.select("node").distinct().join(rest, F.col("node") == F.col("at"), "left")
    now = cut(linked.select("node", F.coalesce("before", "node").alias("to"), F.col("before").isNotNull().cast("long").alias("far")))
    for _ in range(64):
        up = now.select(F.col("node").alias("via"), F.col("to").alias("beyond"), F.col("far").alias("more"))
        after = cut(now.join(up, F.col("to") == F.col("via"), "left").select("node", "to", F.coalesce("beyond", "to").alias("beyond"), (F.col("far") + F.coalesce("more", F.lit(0))).alias("far")))
        still = after.where("to <> beyond").isEmpty()
        now = after.select("node", F.col("beyond").alias("to"), "far")
        if not now.where("node = to and far > 0").isEmpty():
            raise ValueError("a list runs in a circle")
        if still:
            return now.join(first, "node").select(F.col("to").alias("list"), F.col("far").cast("int").alias("place"), "item")
    raise ValueError("a list runs in a circle")


def axioms(spark: SparkSession, base: str = "urn:class:") -> DataFrame:
    """(s, p, o) of the fixed axioms: disjoint pairs, and equivalent classes as intersections, an RDF list of Material and restrictions. Blank nodes are named by their class, so every run gives the same ones."""
    rows = [(base + a, f"{OWL}disjointWith", base + b) for a, b in DISJOINT]
    members = []
    for name in dict.fromkeys(n for n, _, _ in EQUIVALENT):
        both, parts = f"_:{name}", [f"{base}Material"]
        rows += [(base + name, f"{OWL}equivalentClass", both), (both, f"{RDF}type", f"{OWL}Class"), (both, f"{OWL}intersectionOf", f"{both}_items")]
        for i, (_, prop, value) in enumerate(e for e in EQUIVALENT if e[0] == name):
            part = f"{both}_restriction{i}"
            rows += [(part, f"{RDF}type", f"{OWL}Restriction"), (part, f"{OWL}onProperty", base + prop), (part, f"{OWL}someValuesFrom", base + value)]
            parts.append(part)
        members.append((f"{both}_items", parts))
    return spark.createDataFrame(rows, "s string, p string, o string").union(lists(spark.createDataFrame(members, "list string, items array<string>")))


def property_triples(slots: DataFrame, base: str = "urn:class:") -> DataFrame:
    """(s, p, o) of slots (slot, domain, range, inverse, symmetric, transitive, ...): kind, label, description, domain, range, inverse and traits.

    A slot whose range is a type of XML Schema (xsd:...) is a datatype property,
    with that type as its range.
    """
    name = F.concat(F.lit(base), "slot")
    triple = lambda p, o: F.struct(name.alias("s"), F.lit(p).alias("p"), o.alias("o"))
    owl = lambda kind: F.lit(f"{OWL}{kind}")
    is_data = F.coalesce(F.col("range").startswith("xsd:"), F.lit(False))
    target = F.when(is_data, F.replace("range", F.lit("xsd:"), F.lit(XSD))).otherwise(F.concat(F.lit(base), "range"))
    about = F.col("description") if "description" in slots.columns else F.lit(None).cast("string")
    every = F.array(
        triple(f"{RDF}type", F.when(is_data, owl("DatatypeProperty")).otherwise(owl("ObjectProperty"))),
        triple(f"{RDFS}label", F.col("slot")),
        triple(f"{RDFS}comment", about),
        triple(f"{RDFS}domain", F.concat(F.lit(base), "domain")),
        triple(f"{RDFS}range", target),
        triple(f"{OWL}inverseOf", F.concat(F.lit(base), "inverse")),
        triple(f"{RDF}type", F.when(F.col("symmetric"), owl("SymmetricProperty"))),
        triple(f"{RDF}type", F.when(F.col("transitive"), owl("TransitiveProperty"))),
    )
    return slots.select(F.inline(every)).where("o is not null")
