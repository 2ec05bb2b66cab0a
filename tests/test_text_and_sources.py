"""Similarities, text functions, repairs, sources, sinks and incremental merging."""

import json

from pyspark.sql import functions as F

from graphloom.functions import similarity
from graphloom.functions import text as T
from graphloom.operators import ontology, properties, retrieval, skos, terms, years
from graphloom.sources import graph_json
from graphloom.streaming import incremental


def one(spark, column):
    return spark.range(1).select(column).first()[0]


def test_similarities():
    assert round(similarity.ratio("polymer", "conjugatedpolymer")) == 58
    assert similarity.ratio("", "x") == 0 and similarity.ratio("same", "same") == 100
    assert similarity.partial_ratio("rel:RELATED_TO", "RELATED_TO") == 100 and 30 < similarity.partial_ratio("rel:HAS_PART", "RELATED_TO") < 40
    assert similarity.token_sort_ratio("b a", "a b") == 100 and similarity.token_sort_ratio("a", None) == 0
    assert similarity.token_set_ratio("fuzzy was a bear", "fuzzy fuzzy was a bear") == 100 and similarity.token_set_ratio("", "x") == 0
    assert similarity.sequence_ratio("abcd", "bcde") == 0.75


def test_fuzzy_repair(spark):
    names = spark.createDataFrame([("Material", 0), ("ConjugatedPolymer", 1), ("material", 2), ("Device", 3)], "name string, pos int")
    asked = ["Material", "MATERIAL", "Materials", "Polymer", " device ", "Devices", "", None, "Conjugated Polymer"]
    got = ontology.repaired(spark.createDataFrame([(i, a) for i, a in enumerate(asked)], "i int, category string"), names, "category")
    assert {r.i: r.fixed for r in got.collect()} == {0: "Material", 1: "material", 2: "material", 3: None, 4: "Device", 5: "Device", 6: None, 7: None, 8: "ConjugatedPolymer"}
    said = spark.createDataFrame([("Description", "x"), ("has_devise", " y "), ("unlike", "z")], "relation string, related_term string")
    slots = spark.createDataFrame([("has_device", 0)], "name string, pos int")
    assert sorted(tuple(r) for r in ontology.repaired_relations(said, slots).select("relation", "related_term", "verified").collect()) == [("has_device", "y", True), ("unlike", "z", False)]


def test_text_functions(spark):
    assert one(spark, T.snippet(F.lit("First one. Second about Tin here! Third."), F.lit("tin"))) == "Second about Tin here!"
    assert one(spark, T.snippet(F.lit("Only  this"), F.lit("lead"), 1)) == "Only"
    assert one(spark, T.hinted_snippet(F.lit("abcdefghijklmnop"), 8, ["K", "zz"])) == "ijklmnop"
    assert one(spark, T.hinted_snippet(F.lit("abcdefghij"), 4, [])) == "abcd"
    assert one(spark, T.sub_questions(F.lit("What is it? and why; x"))) == ["What is it", "and why"]
    assert one(spark, T.sub_questions(F.lit("a?"))) == ["a?"]
    assert one(spark, T.knowledge_gaps(F.lit("[Domain Knowledge] tin \n[Domain Knowledge]\n"))) == ["tin", "unspecified"]
    assert one(spark, T.terms_object(F.lit('x {"a": {"b": 1}} y {"terms": [{"term": "t", "r": [{"k": 1}]}]} {"terms": 1}'))) == '{"terms": [{"term": "t", "r": [{"k": 1}]}]}'
    assert one(spark, T.terms_object(F.lit("none {"))) is None
    assert one(spark, T.local_name(F.lit("rel:x"))) == "x"


def test_years(spark):
    rows = [(1, "Report of 2001, published here. " + "x" * 60 + " 2003"), (2, "1999 and 1998"), (3, "no 1850 2999"), (4, "Received 2010, Accepted 2010; 2011 2011 2011 2011")]
    got = years.vote(spark.createDataFrame(rows, "doc_id long, text string"), 2026)
    assert {r.doc_id: r.year for r in got.collect()} == {1: 2001, 2: 1999, 4: 2011}


def test_property_sentences(spark):
    rows = [(0, "The melting point of NaCl is 801 °C."), (1, "NaCl density was not given."), (2, "NaCldensity 3 K."), (3, "NaCl has, as far as anybody can tell from this, a density of 2 g.")]
    got = properties.mine(spark.createDataFrame(rows, "page_id long, text string"), spark.createDataFrame([(i, "NaCl") for i in range(4)], "page_id long, material string"))
    found = sorted((r.page_id, r.property, r.raw_value, r.raw_unit, r.verified) for r in got.collect())
    assert found == [(0, "melting_point", "801", "°C", True), (1, "density", None, None, False)]


def test_sources(spark, tmp_path):
    term = {"term": "Tin", "pages": [1], "relations": [{"relation": "USES", "related_term": "Lead"}]}
    (tmp_path / "a.json").write_text(json.dumps({"terms": [term]}))
    (tmp_path / "b.json").write_text(json.dumps([term, {"term": "Zinc"}]))
    assert sorted(r.term for r in graph_json.read_terms(spark, f"{tmp_path}/*.json").collect()) == ["Tin", "Tin", "Zinc"]
    (tmp_path / "g.txt").write_text(json.dumps({"things": [{"id": "a", "name": "A"}, {"name": "none"}], "associations": [{"subject": "a", "predicate": "p", "object": "b"}, {"subject": "a", "object": "b"}]}))
    things, edges = graph_json.read_graph(spark, f"{tmp_path}/g.txt")
    assert [r.id for r in things.collect()] == ["a"] and edges.count() == 1
    graph_json.write_graph(things, edges, f"{tmp_path}/graph")
    assert spark.read.parquet(f"{tmp_path}/graph/things").count() == 1
    (tmp_path / "c.obo").write_text('format: 1\n\n[Term]\nid: C:1\nname: water\ndef: "wet" []\nsynonym: "aqua" EXACT []\nis_a: C:0 ! base\nrelationship: has_role C:9\n\n[Typedef]\nid: r')
    entry = graph_json.read_obo(spark, f"{tmp_path}/c.obo").collect()
    assert [(r.id, r.name, r.definition, r.synonyms, r.parents, r.roles) for r in entry] == [("C:1", "water", "wet", ["aqua"], ["C:0"], ["C:9"])]
    for _ in range(2):
        graph_json.append_gaps(spark.createDataFrame([("q", "e", "r")], "query string, entity string, reason string"), f"{tmp_path}/gaps")
    assert spark.read.json(f"{tmp_path}/gaps").count() == 2
    (tmp_path / "q.txt").write_text("one\n \n two \n")
    assert [r.question for r in graph_json.read_questions(spark, f"{tmp_path}/q.txt").collect()] == ["one", "two"]
    (tmp_path / "s.yaml").write_text("classes:\n  Thing: {description: any}\n  Tin: {is_a: Thing}\nslots:\n  uses: {range: Thing}\n")
    classes, slots = graph_json.read_schema(spark, f"{tmp_path}/s.yaml")
    assert [(r.name, r.is_a, r.pos) for r in classes.collect()] == [("Thing", None, 0), ("Tin", "Thing", 1)] and slots.first().range == "Thing"
    triples = skos.axioms(spark).union(spark.createDataFrame([("urn:a", "urn:label", 'say "hi" \\ now')], "s string, p string, o string"))
    graph_json.write_triples(triples, f"{tmp_path}/nt")
    back = {tuple(r) for r in graph_json.read_triples(spark, f"{tmp_path}/nt").collect()}
    assert back == {tuple(r) for r in triples.collect()} and ("urn:class:Material", f"{skos.OWL}disjointWith", "urn:class:Property") in back
    pdfs = tmp_path / "pdfs"
    pdfs.mkdir()
    for name in ("A.PDF", "b.pdf", "c.txt"):
        (pdfs / name).write_bytes(b"x")
    assert sorted(r.paper for r in graph_json.read_papers(spark, str(pdfs)).collect()) == ["A.PDF", "b.pdf"]


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("m", 25, 1.5), ("m", 50, 2.0), ("n", 25, 0.5)], "model string, papers int, ratio double")
    graph_json.write_table(rows, f"{tmp_path}/csv")
    assert spark.read.option("header", True).csv(f"{tmp_path}/csv").columns == ["model", "papers", "ratio"]
    graph_json.write_grouped(rows, "model", f"{tmp_path}/json")
    assert {r.model: [x.papers for x in r.rows] for r in spark.read.json(f"{tmp_path}/json").collect()} == {"m": [25, 50], "n": [25]}
    graph_json.write_terms(spark.createDataFrame([("a",)], "term string"), f"{tmp_path}/terms")
    assert spark.read.parquet(f"{tmp_path}/terms").first().properties == []
    for i in range(2):
        graph_json.append_answers(spark.createDataFrame([(i, "a")], "question_num int, baseline string"), f"{tmp_path}/answers")
    assert spark.read.json(f"{tmp_path}/answers").count() == 2


def test_incremental_equals_whole(spark, tmp_path):
    schema = "term string, definition string, category string, paper string, page int, ordinal long"
    made = [(f"T{i % 7} ", f"d{i}" * (i % 4), f"c{i % 3}", f"p{i % 5}", i % 6, i) for i in range(60)]
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(schema).json(f"{tmp_path}/in")
    for start in (0, 30):
        spark.createDataFrame(made[start : start + 30], schema).coalesce(1).write.mode("append").json(f"{tmp_path}/in")
        incremental.follow(stream, f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
    key = lambda df: sorted(tuple(map(str, r)) for r in df.collect())
    assert key(incremental.terms(spark, f"{tmp_path}/out")) == key(terms.merge_mentions(spark.createDataFrame(made, schema)))


def test_first_like(spark):
    known = spark.createDataFrame([("polymer blend", 5), ("polymer blends", 2), ("tin", 1)], "name string, ordinal long")
    got = terms.first_like(spark.createDataFrame([(t,) for t in ("Polymer Blend", "polymer blendx", "tim", "zinc")], "term string"), known)
    assert {r.term: r.match for r in got.collect()} == {"polymer blend": "polymer blends", "polymer blendx": "polymer blends"}


def test_vector_ties_and_names(spark):
    vectors = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [1.0, 0.0]), ("c", [0.0, 1.0])], "id string, vec array<float>")
    names = spark.createDataFrame([("a", "Tin!"), ("b", "tin"), ("c", "x")], "id string, name string")
    asked = spark.createDataFrame([(1, [1.0, 0.0])], "query_id int, query array<float>")
    assert sorted((r.id, r.score) for r in retrieval.vector_top_each(vectors, asked, 3, names).collect()) == [("a", 1.0), ("c", 0.5)]


def test_reranked_against_sorting(spark):
    question = "How hard is Silicon carbide under load"
    nodes = [(f"n{i}", name, text) for i, (name, text) in enumerate([("silicon carbide", ""), ("carbide", "hard load"), ("steel", "How hard is it"), (None, None), ("Silicon", "a load"), ("glass", "soft")])]
    hits = [("n0", 0.1), ("n1", 0.9), ("n2", 0.8), ("n2", 0.3), ("n3", 0.7), ("n4", 0.6), ("n5", 0.5)]
    found = retrieval.reranked(spark.createDataFrame(hits, "id string, score double"), spark.createDataFrame(nodes, "id string, name string, description string"), question)
    name, best = {n: (a or "", b or "") for n, a, b in nodes}, {}
    for n, score in hits:
        best[n] = max(score, best.get(n, 0))
    key = {n: (int(f" {name[n][0].lower()} " in f" {question.lower()} "), similarity.token_set_ratio(question, " ".join(name[n])), best[n]) for n in best}
    expected = sorted(key, key=key.get, reverse=True)[:3]
    assert [(r.id, r.exact) for r in found.collect()] == [(n, key[n][0]) for n in expected]
