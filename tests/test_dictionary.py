"""Concepts, whole records, the bucketed store and checkpoint tables, against plain Python."""

import random

from pyspark.sql import functions as F

from graphloom.functions import formula
from graphloom.operators import checkpoints, graph, retrieval, skos, terms
from graphloom.sources import graph_json
from graphloom.streaming import incremental

SCHEMA = (
    "term string, definition string, category string, relations array<struct<relation:string,related_term:string,verified:boolean>>, snippet string, paper string, page int, ordinal long, "
    "formula string, chebi string, smiles string"
)


def made(n, seed=3):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        said = [(rng.choice(["uses", "has"]), rng.choice(["tin", "Lead", None]), rng.random() < 0.5) for _ in range(rng.randint(0, 3))]
        rows.append((
            rng.choice([" Tin", "tin", "Lead", "zinc film", "  ", "Gold"]), "d" * rng.randint(0, 4) + str(i % 3), rng.choice(["Material", "Device", None]), said, f"s{i}", f"p{i % 3}", rng.randint(1, 6), i,
            rng.choice([None, "", "Sn"]), rng.choice([None, None, "C:1"]), rng.choice([None, "smile"]),
        ))
    return rows


def whole(rows):
    """The dictionary by the rules, one mention after another."""
    out = {}
    for term, definition, category, said, snippet, paper, page, _, formula, chebi, smiles in sorted(rows, key=lambda r: r[7]):
        key = term.strip().lower()
        if not key:
            continue
        chemical = {"formula": formula, "chebi": chebi, "smiles": smiles}
        if key not in out:
            out[key] = {"term": term, "definition": definition or "", "category": category or "Thing", "relations": list(said or []), "pages": [page], "papers": [paper], "snippets": [snippet], **{c: v or None for c, v in chemical.items()}}
            continue
        entry = out[key]
        if page not in entry["pages"]:
            entry["pages"].append(page)
            entry["papers"].append(paper)
            entry["snippets"].append(snippet)
        before = {r[:2] for r in entry["relations"]}
        entry["relations"] += [r for r in said or [] if r[:2] not in before]
        if len(definition or "") > len(entry["definition"]):
            entry["definition"] = definition
        if chebi:
            for c, v in chemical.items():
                entry[c] = entry[c] or v or None
    return out


def plain(rows):
    return {
        r.key: {"term": r.term, "definition": r.definition, "category": r.category, "relations": [tuple(x) for x in r.relations], "pages": r.pages, "papers": r.source_papers,
                "snippets": [s.text for s in r.context_snippets], "formula": r.formula or None, "chebi": r.chebi or None, "smiles": r.smiles or None}
        for r in rows
    }


def test_records_equal_one_mention_after_another(spark):
    rows = made(150)
    got = terms.records(spark.createDataFrame(rows, SCHEMA)).collect()
    assert plain(got) == whole(rows)
    assert {r.key: r.importance for r in got}["tin"] == "high"
    assert terms.records(spark.createDataFrame([], SCHEMA)).count() == 0


def test_record_reaches_its_node(spark):
    schema = "term string, definition string, category string, formula string, formula_validation struct<input:string,canonical:string,mp_hits:int,status:string,error:string>, paper string, page int, ordinal long"
    one = spark.createDataFrame([("Tin", "a metal", "Material", "Sn", ("Sn", "Sn1", 3, "ok", None), "p", 2, 1)], schema)
    found = spark.createDataFrame([("tin", "density", 7.3, "g/cm3", 0.1, "Tin has 7.3", True)], "key string, property string, value double, unit string, uncertainty double, context string, verified boolean")
    record = terms.with_properties(terms.records(one), found)
    relations = spark.createDataFrame([], "term string, relation string, related_term string, evidence string, ordinal long")
    node = graph.build(record, relations)[0].collect()
    assert [(n.id, n.formula, n.formula_validation.canonical, [p.property for p in n.properties], n.pages) for n in node] == [("matkg:Tin", "Sn", "Sn1", ["density"], [2])]


def test_concepts(spark):
    said = [
        "GIWAXS", "GI-WAXS", "SEM", "TEM", "XPS", "UPS", "MoTe2", "WTe2", "Al2O3[0001]", "Al2O3", "X-RD", "XRD", "R-SoXS", "resonant soft xray scattering", "Resonant soft xray scattering (RSoXS)",
        "organic solar cells", "OSCs", "Organic solar cells (OSCs)", "band structure", "Dirac-like band structure", "photoemission", "angle-resolved photoemission spectroscopy (ARPES)", "ARPES",
        "ABC", "a big cell (ABC)", "another bad case (ABC)", "α-Sn", "β-Sn", "--", "+", " ", "film (thin)",
    ]
    rows = spark.createDataFrame([(t, i) for i, t in enumerate(said)], "term string, ordinal long")
    key = {r.term: r.key for r in terms.concepts(rows).collect()}
    same = [{t for t in key if key[t] == k} for k in set(key.values())]
    together = [g for g in same if len(g) > 1]
    assert sorted(map(sorted, together)) == sorted(map(sorted, [
        {"GIWAXS", "GI-WAXS"}, {"X-RD", "XRD"}, {"R-SoXS", "resonant soft xray scattering", "Resonant soft xray scattering (RSoXS)"}, {"organic solar cells", "OSCs", "Organic solar cells (OSCs)"},
        {"angle-resolved photoemission spectroscopy (ARPES)", "ARPES"},
    ]))
    assert key["GI-WAXS"] == "giwaxs" and key["RSoXS" if "RSoXS" in key else "R-SoXS"] == "r-soxs" and " " not in key
    merged = terms.merge_mentions(terms.concepts(rows).withColumns({"definition": F.lit("d"), "category": F.lit("c"), "paper": F.lit("p"), "page": F.col("ordinal").cast("int")}))
    assert merged.where("key = 'giwaxs'").first().pages == [0, 1]


def test_groups_against_chains(spark):
    links = [(f"n{i:03d}", f"n{i + 1:03d}") for i in range(0, 40)] + [("x", "y"), ("y", "x"), ("z", "z"), (None, "x")]
    got = {r.node: r.group for r in graph.groups(spark.createDataFrame(links, "a string, b string")).collect()}
    assert got == {f"n{i:03d}": "n000" for i in range(41)} | {"x": "x", "y": "x", "z": "z"}


def written(path):
    return {str(f.relative_to(path)): f.stat().st_mtime_ns for f in path.rglob("*.parquet")}


def test_store_equals_one_merge(spark, tmp_path):
    rows = made(90, 8)
    store = incremental.TermStore(spark, str(tmp_path / "store"), 8)
    assert store.records() is None
    for start in (0, 30, 60):
        store.upsert(spark.createDataFrame(rows[start : start + 30], SCHEMA))
    assert plain(store.records().collect()) == whole(rows)
    before = written(tmp_path / "store")
    assert store.upsert(spark.createDataFrame(rows[30:60], SCHEMA)) == [] and written(tmp_path / "store") == before
    held = store.versions("records")
    touched = store.upsert(spark.createDataFrame([("Gold", "d", "c", [], "s", "p", 9, 1000, None, None, None)], SCHEMA))
    after = store.versions("records")
    assert len(touched) == 1 and {b for b in after if after[b] != held.get(b)} == set(touched) and before.items() <= written(tmp_path / "store").items()
    # A batch that broke off after its mentions: nobody reads them, and its retry gives the whole.
    late = spark.createDataFrame([("Silver", "d", "c", [], "s", "p", 1, 2000, None, None, None)], SCHEMA)
    store.upsert(late)
    last = sorted(store.complete())[-1]
    (tmp_path / "store" / "records" / last / "_SUCCESS").unlink()
    assert "silver" not in {r.key for r in store.records().collect()}
    assert len(store.upsert(late)) == 1 and [r.term for r in store.records().where("key = 'silver'").collect()] == ["Silver"]
    everything = plain(store.records().collect())
    assert store.vacuum() and plain(store.records().collect()) == everything


def test_stream_upserts(spark, tmp_path):
    (tmp_path / "in").mkdir()
    rows = made(40, 9)
    stream = spark.readStream.schema(SCHEMA).json(f"{tmp_path}/in")
    for start in (0, 20):
        spark.createDataFrame(rows[start : start + 20], SCHEMA).coalesce(1).write.mode("append").json(f"{tmp_path}/in")
        incremental.follow(stream, f"{tmp_path}/out", f"{tmp_path}/check", 4).awaitTermination()
    assert plain(incremental.TermStore(spark, f"{tmp_path}/out", 4).records().collect()) == whole(rows)


def test_checkpoint_table(spark, tmp_path):
    rows = [(k, c, f"{k}{c}") for c in (25, 50, 75) for k in range(c // 5 - 3, c // 5 + 4)]
    data = spark.createDataFrame(rows, "key int, checkpoint int, value string")
    kept = checkpoints.CheckpointTable(spark, str(tmp_path / "t"), ["key"])
    kept.save(data)
    wanted = [(c, len({k for k, x, _ in rows if x <= c}), sum(x <= c for _, x, _ in rows)) for c in (25, 50, 75)]
    assert sorted(map(tuple, kept.counts().collect())) == wanted
    state = {r.key: (r.first_checkpoint, r.value) for r in kept.state(50).collect()}
    assert state == {k: min((c, v) for q, c, v in rows if q == k and c <= 50) for k in {q for q, c, _ in rows if c <= 50}}
    before = written(tmp_path / "t")
    kept.save(data.where("checkpoint = 50 and key < 10"))
    after = written(tmp_path / "t")
    assert {f for f in before if f in after} == {f for f in before if "checkpoint=50" not in f}
    assert {r.checkpoint for r in kept.own().select("checkpoint").distinct().collect()} == {25, 50, 75}


def test_resume_from_saved_records(spark, tmp_path):
    rows = made(120, 12)
    early, late = (spark.createDataFrame(part, SCHEMA) for part in (rows[:60], rows[60:]))
    graph_json.export_terms(terms.records(early).drop("ordinal"), f"{tmp_path}/out", per_file=2)
    saved = graph_json.read_terms(spark, f"{tmp_path}/out/part-*")
    assert saved.count() == 4 and len(list((tmp_path / "out").glob("part-*"))) >= 2 and saved.where("size(properties) = 0").count() == 4
    continued = terms.records(terms.as_mentions(saved).unionByName(late, allowMissingColumns=True).drop("key"))
    assert plain(continued.collect()) == whole(rows)
    bare = spark.createDataFrame([("Tin", "d", "c", None, None, None, None)], "term string, definition string, category string, relations array<struct<relation:string,related_term:string,verified:boolean>>, pages array<int>, source_papers array<string>, context_snippets array<struct<text:string,source_paper:string,page:int>>")
    assert [(r.term, r.page) for r in terms.as_mentions(bare).collect()] == [("Tin", None)]


def test_graph_and_schema_documents(spark, tmp_path):
    things = spark.createDataFrame([(f"n{i}", f"name {i}", "c", 'a "b"', [i], ["p"]) for i in range(25)], "id string, name string, category string, description string, pages array<int>, source_papers array<string>")
    edges = spark.createDataFrame([(f"n{i}", "rel:x", f"n{i + 1}", None if i % 2 else "e") for i in range(7)], "subject string, predicate string, object string, has_evidence string")
    graph_json.export_graph(things, edges, f"{tmp_path}/g", per_file=10)
    back = graph_json.read_graph(spark, f"{tmp_path}/g/part-*")
    assert sorted(map(str, back[0].collect())) == sorted(map(str, things.collect())) and sorted(map(str, back[1].collect())) == sorted(map(str, edges.collect()))
    classes = spark.createDataFrame([("Thing", "any", None, 0), ("Tin", None, "Thing", 1)], "name string, description string, is_a string, pos int")
    slots = spark.createDataFrame([("uses", None, None, "Thing", "xsd:float", 0)], "name string, description string, is_a string, domain string, range string, pos int")
    graph_json.write_schema(classes, slots, f"{tmp_path}/schema")
    found = graph_json.read_schema(spark, f"{tmp_path}/schema/part-*")
    assert [sorted(map(tuple, f.collect()), key=str) for f in found] == [sorted(map(tuple, t.collect()), key=str) for t in (classes, slots)]


def test_names_while_they_are_typed(spark):
    rows = spark.createDataFrame([(i, n) for i, n in enumerate(["Steel ring", "string", "tin", None, "RING"])], "id int, name string")
    assert [r.id for r in retrieval.named_like(rows, "Ring", 2).collect()] == [0, 1]


def test_formulas_without_white_space(spark):
    rows = spark.createDataFrame([(f,) for f in ("H2 O1", "Na1", " Na 1 ", "Na", "Xx")], "formula string")
    assert {r.formula: r.formula_validation.status for r in formula.checked(rows).collect()} == {"H2 O1": "corrected", "Na1": "ok", " Na 1 ": "ok", "Na": "corrected", "Xx": "invalid"}


def test_broader_classes_where_nothing_else_is_said(spark):
    kind, label, up = f"{skos.RDF}type", f"{skos.SKOS}prefLabel", f"{skos.SKOS}broader"
    rows = [t for n, text in (("a", "alpha"), ("b", "beta"), ("m", "a method")) for t in ((n, kind, f"{skos.SKOS}Concept"), (n, label, text))] + [("b", up, "a"), ("m", up, "a"), ("a", up, "a")]
    triples = spark.createDataFrame(rows, "s string, p string, o string")
    assert {r["class"]: r.parent for r in skos.classes(triples).collect()} == {"alpha": "Material", "beta": "Material", "a_method": "Method"}
    assert {r["class"]: r.parent for r in skos.classes(triples, by_broader=True).collect()} == {"alpha": "Material", "beta": "alpha", "a_method": "Method"}
