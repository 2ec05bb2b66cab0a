"""RDF lists, property triples, scheme labels, inference, Turtle and OBO values."""

import random

import pytest
from pyspark.sql import functions as F

from graphloom.functions import text as T
from graphloom.operators import context, inference, skos
from graphloom.sources import graph_json, turtle

TRIPLE = "s string, p string, o string"


def rows(df):
    return {tuple(r) for r in df.collect()}


def test_scheme_and_concept_labels(spark):
    both = [(n, f"{skos.RDF}type", f"{skos.SKOS}{k}") for n, k in (("urn:s", "ConceptScheme"), ("urn:c", "Concept"), ("urn:a/tail", "ConceptScheme"))]
    both += [(n, p, o) for n in ("urn:s", "urn:c") for p, o in ((f"{skos.SKOS}prefLabel", "preferred"), (f"{skos.RDFS}label", "plain"))]
    assert {r.id: r.label for r in skos.nodes(spark.createDataFrame(both, TRIPLE)).collect()} == {"urn:s": "plain", "urn:c": "preferred", "urn:a/tail": "tail"}
    assert spark.range(1).select(T.scheme_id(F.lit("x-ray METHODS of 2nd kind"))).first()[0] == "x-ray METHODS of 2nd kind".title().replace(" ", "")


def test_lists_are_written_and_read(spark):
    rng = random.Random(4)
    given = {f"_:l{n}": [f"i{rng.randrange(5)}" for _ in range(n)] for n in (0, 1, 2, 7, 100)}
    made = skos.lists(spark.createDataFrame(list(given.items()), "list string, items array<string>"))
    back = {}
    for name, place, item in rows(skos.read_lists(made)):
        back.setdefault(name, {})[place] = item
    assert {n: [found[i] for i in range(len(found))] for n, found in back.items()} == {n: v for n, v in given.items() if v}
    circle = [("_:a", f"{skos.RDF}first", "x"), ("_:a", f"{skos.RDF}rest", "_:b"), ("_:b", f"{skos.RDF}first", "y"), ("_:b", f"{skos.RDF}rest", "_:a")]
    with pytest.raises(ValueError, match="circle"):
        skos.read_lists(spark.createDataFrame(circle, TRIPLE))


def test_ceramic_by_hand(spark):
    c, rdf, owl = "urn:class:", skos.RDF, skos.OWL
    wanted = {
        (f"{c}Ceramic", f"{owl}equivalentClass", "_:Ceramic"), ("_:Ceramic", f"{rdf}type", f"{owl}Class"), ("_:Ceramic", f"{owl}intersectionOf", "_:Ceramic_items"),
        ("_:Ceramic_items", f"{rdf}first", f"{c}Material"), ("_:Ceramic_items", f"{rdf}rest", "_:Ceramic_items_1"),
        ("_:Ceramic_items_1", f"{rdf}first", "_:Ceramic_restriction0"), ("_:Ceramic_items_1", f"{rdf}rest", "_:Ceramic_items_2"),
        ("_:Ceramic_items_2", f"{rdf}first", "_:Ceramic_restriction1"), ("_:Ceramic_items_2", f"{rdf}rest", f"{rdf}nil"),
        ("_:Ceramic_restriction0", f"{rdf}type", f"{owl}Restriction"), ("_:Ceramic_restriction0", f"{owl}onProperty", f"{c}has_property"), ("_:Ceramic_restriction0", f"{owl}someValuesFrom", f"{c}Hardness"),
        ("_:Ceramic_restriction1", f"{rdf}type", f"{owl}Restriction"), ("_:Ceramic_restriction1", f"{owl}onProperty", f"{c}has_property"), ("_:Ceramic_restriction1", f"{owl}someValuesFrom", f"{c}BrittlenessToughness"),
    }
    made = rows(skos.axioms(spark))
    assert {t for t in made if "Ceramic" in t[0]} == wanted
    assert len({t for t in made if t[1] == f"{owl}disjointWith"}) == 10


def test_property_triples(spark):
    made = rows(skos.property_triples(inference.catalogue(spark), "u:"))
    of = lambda s: {(p.split("#")[-1], o.split("#")[-1]) for x, p, o in made if x == s}
    assert of("u:part_of") == {("type", "ObjectProperty"), ("type", "TransitiveProperty"), ("label", "part_of"), ("domain", "u:Structure"), ("range", "u:Structure"), ("inverseOf", "u:has_component")}
    assert of("u:has_value") == {("type", "DatatypeProperty"), ("label", "has_value"), ("domain", "u:Property"), ("range", "float")}
    assert of("u:interacts_with") == {("type", "ObjectProperty"), ("type", "SymmetricProperty"), ("label", "interacts_with")}


def fixpoint(triples, slots, classes):
    """All that follows, rule by rule until nothing is new."""
    known = set(triples)
    while True:
        new = set()
        for s, p, o in known:
            for slot, up, inverse, symmetric, transitive in slots:
                if p == slot:
                    if up:
                        new.add((s, up, o))
                    if inverse:
                        new.add((o, inverse, s))
                    if symmetric:
                        new.add((o, p, s))
                    if transitive:
                        new |= {(s, p, y) for x, q, y in known if q == p and x == o}
                if p == inverse:
                    new.add((o, slot, s))
            if p == "type":
                new |= {(s, p, up) for name, up in classes if name == o and up}
        if new <= known:
            return known
        known |= new


def test_inference_against_python(spark):
    slots = inference.catalogue(spark)
    plain = [(r.slot, r.is_a, r.inverse, r.symmetric, r.transitive) for r in slots.collect()]
    classes = [("Polymer", "Material"), ("Material", "NamedThing"), ("NamedThing", None)]
    tree = spark.createDataFrame(classes, "name string, is_a string")
    rng = random.Random(2)
    chain = [(f"n{i}", "part_of", f"n{i + 1}") for i in range(40)]
    circle = [("a", "has_component", "b"), ("b", "has_component", "c"), ("c", "has_component", "a"), ("a", "dissolves_in", "water"), ("p", "type", "Polymer"), ("x", "unheard", "y")]
    names = [s[0] for s in plain]
    mixed = [(f"m{rng.randrange(8)}", rng.choice(names), f"m{rng.randrange(8)}") for _ in range(25)]
    for given in (chain, circle, mixed, []):
        got = rows(inference.infer(spark.createDataFrame([*given, (None, "part_of", "x")], TRIPLE), slots, tree))
        assert got == fixpoint(given, plain, classes)


TURTLE = """@prefix ex: <http://ex.org/> . # a comment
PREFIX skos: <http://www.w3.org/2004/02/skos/core#>
@base <http://base.org/> .
ex:a a skos:Concept ; skos:prefLabel "alpha \\"one\\""@en , 'al\\u0070ha' ;
  ex:n 1.5, -2e3, true ; ex:p <rel> .
<http://ex.org/b> ex:has [ ex:k "v"^^ex:t ; ex:l ( ex:x "y" ) ] ; .
_:named ex:q \"\"\"long "quoted"
text\"\"\" .
[ ex:only "one" ] .
ex:broken ex:p .
ex:after unknown:name "x" .
ex:last ex:p ex:o.
"""


def test_turtle(spark, tmp_path):
    (tmp_path / "a.ttl").write_text(TURTLE)
    found, faults = turtle.read_turtle(spark, f"{tmp_path}/*.ttl")
    e, rdf = "http://ex.org/", skos.RDF
    anonymous = sorted({x for t in rows(found) for x in (t[0], t[2]) if x.startswith("_:") and x != "_:named"}, key=lambda x: int(x.rsplit("_", 1)[1]))
    name = {x: f"B{i}" for i, x in enumerate(anonymous)}
    got = {tuple(name.get(x, x) for x in t) for t in rows(found)}
    assert got == {
        (f"{e}a", f"{rdf}type", f"{skos.SKOS}Concept"), (f"{e}a", f"{skos.SKOS}prefLabel", 'alpha "one"'), (f"{e}a", f"{skos.SKOS}prefLabel", "alpha"),
        (f"{e}a", f"{e}n", "1.5"), (f"{e}a", f"{e}n", "-2e3"), (f"{e}a", f"{e}n", "true"), (f"{e}a", f"{e}p", "http://base.org/rel"),
        (f"{e}b", f"{e}has", "B0"), ("B0", f"{e}k", "v"), ("B0", f"{e}l", "B1"), ("B1", f"{rdf}first", f"{e}x"), ("B1", f"{rdf}rest", "B2"), ("B2", f"{rdf}first", "y"), ("B2", f"{rdf}rest", f"{rdf}nil"),
        ("_:named", f"{e}q", 'long "quoted"\ntext'), ("B3", f"{e}only", "one"), (f"{e}last", f"{e}p", f"{e}o"),
    }
    assert [(r.line, r.path.endswith("a.ttl")) for r in faults.orderBy("line").collect()] == [(10, True), (11, True)]
    again, _ = turtle.read_turtle(spark, f"{tmp_path}/*.ttl")
    assert rows(again) == rows(found)


def test_turtle_equals_its_n_triples(spark, tmp_path):
    given = [(f"http://ex.org/s{i % 7}", f"http://ex.org/p{i % 3}", v) for i, v in enumerate(["http://ex.org/o", 'a "b" \\ c', "long " * 30_000, "", "x.y;z"])]
    data = spark.createDataFrame(given, TRIPLE)
    graph_json.write_triples(data, f"{tmp_path}/nt")
    (tmp_path / "twin.ttl").write_text("\n".join(f"<{s}> <{p}> {'<' + o + '>' if o.startswith('http') else chr(34) + o.replace(chr(92), chr(92) * 2).replace(chr(34), chr(92) + chr(34)) + chr(34)} ." for s, p, o in given))
    found, faults = turtle.read_turtle(spark, f"{tmp_path}/twin.ttl")
    assert rows(found) == rows(graph_json.read_triples(spark, f"{tmp_path}/nt")) == set(given) and faults.count() == 0


def test_long_replies_and_literals(spark, tmp_path):
    nested = '{"terms": [{"term": "' + "x" * 200_000 + '", "r": [{"k": 1}]}], "meta": {"a": {"b": 2}}}'
    many = '{"terms": [' + ", ".join(f'{{"term": "t{i}", "definition": "some words"}}' for i in range(5000)) + "]}"
    replies = spark.createDataFrame([(1, f"Sure {nested} and {{more"), (2, f"{many} {{}} {{"), (3, "{" * 100_000), (4, "{a" * 50_000 + "}" * 50_000), (5, "no " * 70_000)], "i int, reply string")
    found = {r.i: r.found for r in replies.select("i", T.terms_object(F.col("reply")).alias("found")).collect()}
    assert found == {1: nested, 2: many, 3: None, 4: None, 5: None}
    literal = "y\\\\ " * 25_000
    (tmp_path / "long.nt").write_text(f'<urn:a> <urn:b> "{literal}" .\n')
    assert len(graph_json.read_triples(spark, f"{tmp_path}/long.nt").first().o) == 75_000


def test_obo_values(spark, tmp_path):
    stanza = (
        "[Term]\nid: C:1\nname: x\nxref: CAS:1-2\nxref: KEGG:C9 \"n\"\nproperty_value: http://purl.obolibrary.org/obo/chebi/formula \"C2 H4\" xsd:string\n"
        "property_value: http://purl.obolibrary.org/obo/chebi/mass \"1.0\" xsd:string\nproperty_value: http://purl.obolibrary.org/obo/chebi/mass \"14.007\"^^xsd:string\n"
        "property_value: http://purl.obolibrary.org/obo/chebi/monoisotopicmass \"9\" xsd:string\nrelationship: has_role C:3\nrelationship: has_part C:4 ! four\n"
    )
    (tmp_path / "c.obo").write_text("format: 1\n\n" + stanza)
    r = graph_json.read_obo(spark, f"{tmp_path}/c.obo").first()
    assert (r.formula, r.mass, r.charge, r.xrefs, r.roles, [tuple(x) for x in r.relationships]) == ("C2", "14.007", None, ["CAS:1-2", "KEGG:C9"], ["C:3"], [("has_role", "C:3"), ("has_part", "C:4")])


def test_evidence_and_names(spark, tmp_path):
    ranked = spark.createDataFrame([(1, 0), (1, 0), (2, 0), (2, 3)], "question_id int, evidence_ct int")
    assert rows(context.without_evidence(ranked)) == {(1, True), (2, False)}
    assert context.without_evidence(ranked.where("false").drop("question_id")).first()[0] is True
    (tmp_path / "a.json").write_text('{"terms": [{"term": "Tin"}, {"definition": "none"}]}')
    (tmp_path / "b.json").write_text('{"words": 1}')
    names, faults = graph_json.read_term_names(spark, f"{tmp_path}/*.json")
    assert [r.term for r in names.collect()] == ["Tin"] and [r.path.rsplit("/")[-1] for r in faults.collect()] == ["b.json"]
