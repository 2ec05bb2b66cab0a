"""Registered queries of text, repair, merging, context, checkpoints and the class hierarchy, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import formula
from graphloom.functions import text as T
from graphloom.operators import checkpoints, context, graph, ontology, properties, retrieval, skos, terms, years
from graphloom.operators.steps import cut
from graphloom.plans.queries import _EDGES, _ID, _t, edges, things
from graphloom.sources.graph_json import whole_texts

WS = r"[ \t\n\x0B\f\r]+"
#: Made-up values that the queries below put into texts.
FORMULAS = ["H2O", "H2 O1", "Ca(OH){n}", "LiFePO{n}", "Fe{n}", "Xx{n}", "(H{n}", "Mg0.5Fe0.5O{n}"]
CANONICAL = ["H2 O1", "H2 O1", "Ca1 H{n} O{n}", "Li1 Fe1 P1 O{n}", "Fe{n}", None, None, "Mg0.5 Fe0.5 O{n}"]
SENTENCES = [
    "The {p} of {m} is {n}.5 g/cm3.",
    "{m} shows a {p} of {n} ± 0.5 eV.",
    "The {p} was high.",
    "{m}{p} 7 K.",
    "{m}, which was made in a furnace far away from here, has a {p} of {n} K.",
    "For {m} no {p} was found.",
]


def context_snippet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each document, the snippet about its last word."""
    last = F.coalesce(F.try_element_at(F.filter(F.split("text", r"\s+"), lambda w: w != ""), F.lit(-1)), F.lit(""))
    return _t(spark, sf_dir, "documents").where("text is not null").select("doc_id", T.snippet(F.col("text"), last).alias("snippet"))


def hinted_snippet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "documents").where("text is not null").select("doc_id", T.hinted_snippet(F.col("text"), 200, ["Queux", "ieren", "ung "]).alias("snippet"))


def json_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The terms object of made-up replies, of which some have none or a smaller one."""
    inner = F.concat(F.lit('{"terms": [{"term": "'), "event_type", F.lit('"}], "meta": '), "props", F.lit("}"))
    short = F.lit('{"terms": []}')
    reply = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit('Sure: {"k": "a longer object than any other one that has no list of what was asked for"} '), inner, short)).when(F.col("event_id") % 3 == 1, F.concat(short, "props")).otherwise(F.col("props"))
    return _t(spark, sf_dir, "events").select("event_id", T.terms_object(reply).alias("found"))


def gap_capture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marked knowledge gaps of turns, in lines that are added to them."""
    mark = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("\n[Domain Knowledge] about "), "role", F.lit("\nand [Domain Knowledge] \n"))).otherwise(F.lit(""))
    said = F.concat(F.coalesce("text", F.lit("")), mark)
    return _t(spark, sf_dir, "conversations").select("conv_id", "turn", F.explode(T.knowledge_gaps(said)).alias("entity"))


def question_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "conversations").where("text is not null").select("conv_id", "turn", "text")
    return rows.select("conv_id", "turn", F.array_join(T.sub_questions(F.col("text")), "|").alias("parts"), F.size(T.query_entities(F.col("text"))).cast("long").alias("n_entities"))


def text_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.col("p_name")
    return _t(spark, sf_dir, "part").select(
        "p_partkey",
        T.without_escapes(F.concat(F.lit("\x1b[31m"), name, F.lit("\x1b[0m"))).alias("plain"),
        T.digest_id(name).alias("digest"),
        T.file_safe(F.concat(F.lit("doi:10/"), name)).alias("safe"),
        T.class_id(F.concat("p_size", F.lit(" "), name)).alias("class_id"),
        T.scheme_id(name).alias("scheme_id"),
        T.label_or_tail(F.when(F.col("p_partkey") % 2 == 0, name), F.concat(F.lit("urn/a/"), "p_brand")).alias("label"),
        T.named_in(F.lit("Is a Red Widget or a small ring stronger"), name).alias("named"),
        T.embedding_text(name, F.col("p_type")).alias("graph_text"),
        T.looks_like_formula(F.concat(F.lit("Na"), "p_size")).alias("formula_like"),
        T.triple_text(name, F.lit("a:b:of"), F.col("p_type")).alias("triple"),
        T.local_name(F.concat(F.lit("rel:"), "p_type")).alias("local"),
        T.cross_reference(F.concat("p_brand", F.when(F.col("p_size") > 9, F.lit(":x:1")).otherwise(F.lit(""))))["db"].alias("db"),
    )


def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = ontology.schema_text(_t(spark, sf_dir, "region").select(F.col("r_name").alias("name"), F.lit("a region").alias("description")), "Classes")
    pages = _t(spark, sf_dir, "documents").where("text is not null").select("doc_id", "text")
    return pages.join(F.broadcast(schema)).select("doc_id", F.sha2(T.extraction_prompt(F.col("schema_text"), F.col("text")).cast("binary"), 256).alias("prompt_sha256"), F.length(T.answer_prompt(F.col("text"), F.col("schema_text"))).cast("long").alias("answer_chars"))


def whole_talks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "conversations").select(F.col("conv_id").alias("paper"), F.col("turn").alias("page"), "text")
    return whole_texts(rows).select(F.col("paper").alias("conv_id"), "text")


def year_guess(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Years in documents, to which lines with years and words near and far are added."""
    n = F.col("doc_id")
    lines = F.concat(F.lit("\nReport of "), (1990 + n % 9).cast("string"), F.lit(", published here. Volume 3 Issue "), (1990 + n % 5).cast("string"), F.lit(" and then far away from any of these words and lines: 2003 2150 2003\nReceived "), (1998 + n % 7).cast("string"))
    rows = _t(spark, sf_dir, "documents").select("doc_id", F.concat(F.coalesce("text", F.lit("")), lines).alias("text"))
    return years.vote(rows, 2100)


def file_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    yy = F.format_string("%02d", F.year("o_orderdate") % 100)
    name = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("a/"), yy, F.lit("07.01234v2.pdf"))).when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit("cond-mat_"), yy, F.lit("10522.pdf"))).otherwise(F.concat(yy, F.lit("07.pdf")))
    return _t(spark, sf_dir, "orders").select("o_orderkey", years.year_of_name(name, 2025).alias("year"))


def run_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.element_at(F.array(*map(F.lit, ["matkg_deepseek-r1_14b_{}_x.json", "matkg_gpt-oss_20b_{}_x.json", "matkg_qwen3_235b_{}papers_x.json", "matkg_gemini_x_{}_x.json"])), (F.col("o_orderkey") % 4 + 1).cast("int"))
    run = checkpoints.run_of(F.replace(kind, F.lit("{}"), (F.year("o_orderdate") - 1990).cast("string")))
    return _t(spark, sf_dir, "orders").select("o_orderkey", run["model"].alias("model"), run["papers"].alias("papers"))


def property_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that differ in material, phrase, distance and unit; some say nothing."""
    part = _t(spark, sf_dir, "part")
    phrase = F.element_at(F.array(*map(F.lit, ["band gap", "density", "melting point"])), (F.col("p_partkey") % 3 + 1).cast("int"))
    made = F.element_at(F.array(*map(F.lit, SENTENCES)), (F.col("p_partkey") % len(SENTENCES) + 1).cast("int"))
    for mark, value in (("{p}", phrase), ("{m}", F.col("p_name")), ("{n}", F.col("p_size").cast("string"))):
        made = F.replace(made, F.lit(mark), value)
    pages = part.select(F.col("p_partkey").alias("page_id"), F.concat(F.lit("An intro. "), made, F.lit(" The end.")).alias("text"))
    return properties.mine(pages, part.select(F.col("p_partkey").alias("page_id"), F.col("p_name").alias("material"))).drop("no")


def formula_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = lambda given: F.replace(F.element_at(F.array(*map(F.lit, given)), (F.col("p_partkey") % len(given) + 1).cast("int")), F.lit("{n}"), F.col("p_size").cast("string"))
    rows = _t(spark, sf_dir, "part").select("p_partkey", "p_size", made(FORMULAS).alias("formula"))
    hits = rows.where("p_partkey % 8 in (0, 2) or p_partkey % 8 = 4 and p_size % 2 = 0").select(made(CANONICAL).alias("formula"), F.lit(3).alias("hits")).distinct()
    return formula.checked(rows, hits).select("p_partkey", "formula_validation.canonical", "formula_validation.mp_hits", "formula_validation.status")


def ontology_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = _t(spark, sf_dir, "part")
    entries = part.where("p_partkey % 3 > 0").select(F.concat(F.lit("X:"), "p_partkey").alias("id"), F.col("p_name").alias("name"), F.array("p_brand", F.lit(None)).alias("synonyms"), F.col("p_partkey").alias("ordinal"))
    asked = part.select("p_partkey", F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit(" "), F.upper("p_name"))).otherwise(F.concat("p_brand", F.lit("\t"))).alias("term"))
    return ontology.lookup(asked, cut(ontology.name_index(entries))).select("p_partkey", "ontology_id")


def category_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Categories by exact name, or but for case; others are too unlike any to be taken."""
    names = _t(spark, sf_dir, "region").select(F.col("r_name").alias("name"), F.col("r_regionkey").cast("int").alias("pos"))
    region = _t(spark, sf_dir, "nation").join(_t(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    value = F.when(F.col("n_nationkey") % 3 == 0, F.col("r_name")).when(F.col("n_nationkey") % 3 == 1, F.concat(F.lit(" "), F.lower("r_name"))).otherwise(F.lit("zzzzzz"))
    return ontology.repaired(region.select("n_nationkey", value.alias("category")), names, "category").select("n_nationkey", "fixed")


def _schema(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    nation = _t(spark, sf_dir, "nation").join(_t(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    classes = nation.select(F.col("n_name").alias("name"), F.col("r_name").alias("is_a")).union(_t(spark, sf_dir, "region").select("r_name", F.lit("Thing")))
    classes = classes.union(spark.range(1).select(F.lit("Thing"), F.lit(None).cast("string")))
    slots = spark.range(3).select(F.concat(F.lit("slot"), "id").alias("name"), F.when(F.col("id") == 2, F.lit("ASIA")).alias("domain"), F.when(F.col("id") == 0, F.lit("Thing")).when(F.col("id") == 1, F.lit("string")).alias("range"))
    return classes, slots


def relation_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes, slots = _schema(spark, sf_dir)
    supplier = _t(spark, sf_dir, "supplier").join(_t(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    known = supplier.select(F.col("s_name").alias("term"), F.col("n_name").alias("category"))
    said = supplier.select(F.col("s_name").alias("term"), F.concat(F.lit("slot"), F.col("s_suppkey") % 4).alias("relation"), F.regexp_replace("s_name", "[02468]$", "1").alias("related_term"), (F.col("s_suppkey") % 7 > 0).alias("verified"))
    return ontology.validity(said, known, classes, slots)


def xrefs_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "events").select(F.col("user_id").alias("id"), F.concat("event_type", F.when(F.col("event_id") % 5 > 0, F.concat(F.lit(":"), "event_id")).otherwise(F.lit(""))).alias("xref"))
    return ontology.by_source(rows).select("id", F.explode("xrefs").alias("db", "refs")).select("id", "db", F.array_join("refs", ",").alias("refs"))


def edges_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.element_at(F.array(*map(F.lit, ["is_a", "has_role", "part_of"])), (F.col("s_suppkey") % 3 + 1).cast("int"))
    rows = _t(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("source"), kind.alias("predicate"), F.col("s_name").alias("target"))
    out = ontology.edges_by_kind(rows)
    return out.select("id", *(F.array_join(c, ",").alias(c) for c in ("roles", "parents", "others")))


def path_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = graph.shortest_path(edges(spark, sf_dir), "part:1", "part:7")
    return found.select(F.size("path").cast("long").alias("nodes"), F.get("path", F.lit(0)).alias("first"), F.element_at("path", -1).alias("last"))


def isolated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.isolate(cut(edges(spark, sf_dir)), "supplier:1")


def additive_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    seeds = spark.range(1, 4).select(F.concat(F.lit("part:"), "id").alias("id"))
    return graph.additive_search(cut(edges(spark, sf_dir)), seeds, 2).select("id", F.round("score", 6).alias("score"))


def multi_query_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best score of each node over six sub-queries' dozen hits, nodes of one name merged in each."""
    rows = _t(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    vectors = rows.select(F.concat(F.lit("part:"), "vec_id").alias("id"), F.col("embedding").alias("vec"))
    asked = rows.where("vec_id < 6").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    return retrieval.merged_seeds(retrieval.vector_top_each(vectors, asked, 12, things(spark, sf_dir))).select("id", F.round("score", 6).alias("score"))


def label_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = _t(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("name"))
    return retrieval.named_like(named, "RING", 20, "p_partkey").select("p_partkey", F.col("name").alias("p_name"))


def bucket_25(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checkpoints.bucketed(_t(spark, sf_dir, "documents").select(F.concat(F.lit("p"), "doc_id").alias("paper")))


def first_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checkpoints.bucketed(_t(spark, sf_dir, "documents").select(F.concat(F.lit("p"), "doc_id").alias("paper")), most=100)


def cumulative_checkpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers that each year's checkpoint has, with those of the years before."""
    rows = _t(spark, sf_dir, "orders").select(F.year("o_orderdate").alias("bucket"), "o_custkey").distinct()
    return checkpoints.cumulative(rows).groupBy("checkpoint").agg(F.countDistinct("o_custkey").alias("customers"), F.count("*").alias("rows"))


def _mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    some = lambda n, c: F.when(F.col("p_partkey") % n == 0, F.concat(F.lit(c), "p_partkey"))
    relation = F.struct(F.col("p_brand").alias("relation"), F.col("p_name").alias("related_term"), (F.col("p_size") > 25).alias("verified"))
    return _t(spark, sf_dir, "part").select(F.col("p_type").alias("term"), F.col("p_brand").alias("paper"), F.col("p_size").alias("page"), F.col("p_partkey").alias("ordinal"), some(5, "c").alias("chebi"), some(3, "f").alias("formula"), some(10, "s").alias("smiles"), F.array(relation, relation).alias("relations"))


def filled_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    return terms.filled_content(_mentions(spark, sf_dir), ["chebi", "formula", "smiles"])


def merged_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return terms.merged_relations(_mentions(spark, sf_dir))


def older_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = terms.older_merge(_mentions(spark, sf_dir))
    return out.select("key", F.array_join(F.col("pages").cast("array<string>"), ",").alias("pages"), F.array_join("source_papers", ",").alias("source_papers"), "total_occurrences", "paper_count")


def attached_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = _t(spark, sf_dir, "part")
    known = part.where("p_partkey % 2 = 0").select(F.lower("p_name").alias("key"))
    found = part.select(F.upper("p_name").alias("material"), F.col("p_type").alias("property"), F.when(F.col("p_size") > 9, F.col("p_size") / 4).alias("normalized_value"), F.lit("K").alias("normalized_unit"), F.lit(0.5).alias("uncertainty_value"), F.col("p_brand").alias("context"), (F.col("p_size") <= 9).alias("unit_conversion_failed"), F.col("p_partkey").alias("ordinal"))
    return terms.attached_properties(known, found)


def relation_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts whose measured properties are phrases that name one, or types that don't."""
    said = F.when(F.col("p_partkey") % 3 == 0, " Band Gap").when(F.col("p_partkey") % 3 == 1, F.col("p_type"))
    measured = F.struct(F.lit("measured_property").alias("relation"), said.alias("related_term"), F.when(F.col("p_size") > 9, F.col("p_size") > 25).alias("verified"))
    other = F.struct(F.lit("made_by").alias("relation"), F.col("p_brand").alias("related_term"), F.lit(True).alias("verified"))
    return properties.from_relations(_t(spark, sf_dir, "part").select(F.concat(F.col("p_name"), F.lit(" ")).alias("term"), F.array(measured, other).alias("relations")))


def run_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _t(spark, sf_dir, "documents").select(F.col("source").alias("paper"), F.col("doc_id").alias("page"), "text")
    return terms.run_counters(pages, _mentions(spark, sf_dir))


def _node_terms(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    part = _t(spark, sf_dir, "part")
    own = part.select(F.when(F.col("p_partkey") % 9 > 0, F.col("p_name")).alias("term"), F.col("p_brand").alias("name"), F.col("p_brand").alias("category"), F.col("p_type").alias("definition"), F.array(F.col("p_size").cast("int")).alias("pages"), F.array("p_brand").alias("source_papers"), F.when(F.col("p_size") > 25, F.lit("H2O")).alias("formula"), F.col("p_partkey").alias("ordinal"))
    evidence = F.when(F.col("p_size") > 20, F.array("p_type", "p_brand")).when(F.col("p_size") > 10, F.array("p_type")).otherwise(F.array().cast("array<string>"))
    said = part.select(F.col("p_name").alias("term"), F.when(F.col("p_size") > 5, F.lit("MADE_BY")).alias("relation"), F.col("p_brand").alias("related_term"), evidence.alias("evidence"), F.col("p_partkey").alias("ordinal"))
    return own, said


def node_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = graph.build(*_node_terms(spark, sf_dir))[0]
    return made.select("id", "name", "category", "description", "formula", F.array_join(F.col("pages").cast("array<string>"), ",").alias("pages"), F.array_join("source_papers", ",").alias("source_papers"))


def joined_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.build(*_node_terms(spark, sf_dir))[1]


def answer_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The context of five questions, among which all parts are dealt."""
    part = _t(spark, sf_dir, "part")
    ranked = part.select((F.col("p_partkey") % 5).alias("question_id"), F.col("p_partkey").alias("rank"), F.concat(F.lit("part:"), "p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("category"), (F.col("p_size") / 7).alias("score_prp"), F.when(F.col("p_size") > 20, F.col("p_brand")).otherwise("").alias("description"), F.when(F.col("p_size") > 30, F.lit("H2O")).alias("formula"), F.array("p_brand", F.lit("none"), F.lit("Brand#1"), F.lit("Brand#2")).alias("source_papers"))
    papers = _t(spark, sf_dir, "documents").select(F.concat(F.lit("Brand#"), "doc_id").alias("paper"), "text")
    names = things(spark, sf_dir).select("id", "name")
    return context.assembled(ranked, cut(edges(spark, sf_dir)), names, papers, ["ieren", "ung "], 4000)


def _triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    iri = lambda kind, key: F.concat(F.lit(f"urn:x/{kind}/"), key)
    nation, region = _t(spark, sf_dir, "nation"), _t(spark, sf_dir, "region")
    at = skos.SKOS
    parts = [
        region.select(iri("scheme", "r_regionkey").alias("s"), F.lit(f"{skos.RDF}type").alias("p"), F.lit(f"{at}ConceptScheme").alias("o")),
        region.select(iri("scheme", "r_regionkey"), F.lit(f"{at}prefLabel"), F.when(F.col("r_regionkey") == 0, F.lit("physical property")).otherwise(F.lower("r_name"))),
        nation.select(iri("c", "n_nationkey"), F.lit(f"{skos.RDF}type"), F.lit(f"{at}Concept")),
        nation.where("n_nationkey % 4 > 0").select(iri("c", "n_nationkey"), F.lit(f"{skos.RDFS}label"), F.when(F.col("n_nationkey") % 4 == 1, F.concat(F.lit("a method "), "n_nationkey")).otherwise(F.col("n_name"))),
        nation.where("n_nationkey % 3 > 0").select(iri("c", "n_nationkey"), F.lit(f"{at}inScheme"), iri("scheme", "n_regionkey")),
        nation.where("n_nationkey % 2 = 0").select(iri("c", "n_nationkey"), F.lit(f"{at}definition"), F.concat(F.lit("about "), "n_name")),
        nation.where("n_nationkey > 0").select(iri("c", F.floor(F.col("n_nationkey") / 2)), F.lit(f"{at}narrower"), iri("c", "n_nationkey")),
        nation.where("n_nationkey > 9").select(iri("c", "n_nationkey"), F.lit(f"{at}broader"), iri("c", F.col("n_nationkey") - 9)),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out


def class_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return skos.classes(_triples(spark, sf_dir))


def narrower_inversion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return skos.broader(_triples(spark, sf_dir))


def class_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return skos.class_triples(skos.classes(_triples(spark, sf_dir)))


QUERIES = {f.__name__: f for f in [context_snippet, hinted_snippet, json_terms, gap_capture, question_parts, text_forms, prompts, whole_talks, year_guess, file_years, run_names, property_mentions, formula_checks, ontology_lookup, category_repair, relation_validity, xrefs_by_source, edges_by_kind, path_length, isolated, additive_search, multi_query_seeds, label_search, bucket_25, first_buckets, cumulative_checkpoint, filled_content, merged_relations, older_merge, attached_properties, relation_properties, run_counters, node_content, joined_evidence, answer_context, class_hierarchy, narrower_inversion, class_triples]}

_SENT = "string_split(regexp_replace({}, '([.?!])[ \\t\\n\\x0B\\f\\r]+', '\\1' || chr(1), 'g'), chr(1))"
_RS, _OS, _SK = skos.RDF, skos.RDFS, skos.SKOS
_TRIPLES = f"""t as (
  select 'urn:x/scheme/' || r_regionkey as s, '{_RS}type' as p, '{_SK}ConceptScheme' as o from region
  union all select 'urn:x/scheme/' || r_regionkey, '{_SK}prefLabel', case when r_regionkey = 0 then 'physical property' else lower(r_name) end from region
  union all select 'urn:x/c/' || n_nationkey, '{_RS}type', '{_SK}Concept' from nation
  union all select 'urn:x/c/' || n_nationkey, '{_OS}label', case when n_nationkey % 4 = 1 then 'a method ' || n_nationkey else n_name end from nation where n_nationkey % 4 > 0
  union all select 'urn:x/c/' || n_nationkey, '{_SK}inScheme', 'urn:x/scheme/' || n_regionkey from nation where n_nationkey % 3 > 0
  union all select 'urn:x/c/' || n_nationkey, '{_SK}definition', 'about ' || n_name from nation where n_nationkey % 2 = 0
  union all select 'urn:x/c/' || (n_nationkey // 2), '{_SK}narrower', 'urn:x/c/' || n_nationkey from nation where n_nationkey > 0
  union all select 'urn:x/c/' || n_nationkey, '{_SK}broader', 'urn:x/c/' || (n_nationkey - 9) from nation where n_nationkey > 9
)"""
_DOMAINS = ", ".join(f"('{d}', {i})" for i, d in enumerate(skos.DOMAIN))
_CLASSES = f"""{_TRIPLES}, d(domain, pos) as (values {_DOMAINS}), n as (
  select s as id, max(string_split(o, '#')[-1]) filter (where p = '{_RS}type') as kind, coalesce(min(o) filter (where p = '{_SK}prefLabel'), min(o) filter (where p = '{_OS}label'), string_split(s, '/')[-1]) as label,
         min(o) filter (where p = '{_SK}definition') as definition, min(o) filter (where p = '{_SK}inScheme') as scheme from t group by s
), m as (
  select n.*, (select arg_min(domain, pos) from d where contains(lower(n.label), lower(domain))) as hit from n where kind is not null
), named as (
  select *, case when kind = 'ConceptScheme' then coalesce(hit, array_to_string(list_transform(string_split(label, ' '), lambda w: upper(w[1]) || lower(w[2:])), ''))
                 else (case when regexp_matches(label, '^[A-Za-z]') then '' else 'X' end) || regexp_replace(label, '[^A-Za-z0-9_]', '_', 'g') end as class from m
), classes as (
  select a.class, arg_min(a.label, a.id) as title, arg_min(coalesce(a.definition, ''), a.id) as description, arg_min(coalesce(b.class, a.hit, 'Material'), a.id) as parent
  from named a left join named b on a.scheme = b.id where a.class not in (select domain from d) group by a.class
)"""
_MENTIONS = """m as (
  select p_type as term, lower(trim(p_type)) as key, p_brand as paper, p_size as page, p_partkey as ordinal, case when p_partkey % 5 = 0 then 'c' || p_partkey end as chebi,
         case when p_partkey % 3 = 0 then 'f' || p_partkey end as formula, case when p_partkey % 10 = 0 then 's' || p_partkey end as smiles, p_name, p_brand, p_size from part
)"""
_HINTS = "list_min(list_filter([instr(lower(text), 'queux'), instr(lower(text), 'ieren'), instr(lower(text), 'ung ')], lambda i: i > 0))"
_PHRASES = ", ".join(f"('{k}', '{v}')" for k, v in properties.KEYWORDS.items())
_MADE = "[" + ", ".join("'" + s.replace("'", "''") + "'" for s in SENTENCES) + "]"
_YEAR = r"\b(?:19|20)\d\d\b"

ORACLE_SQL = {
    "context_snippet": f"""
with d as (select doc_id, text, regexp_extract(text, '([^ \\t\\n\\x0B\\f\\r]+)[ \\t\\n\\x0B\\f\\r]*$', 1) as w from documents where text is not null),
s as (select doc_id, trim(coalesce(list_filter({_SENT.format("text")}, lambda s: contains(lower(s), lower(w)))[1], text), ' ') as found from d)
select doc_id, array_to_string(regexp_split_to_array(found, '{WS}')[1:50], ' ') as snippet from s
""",
    "hinted_snippet": f"""
select doc_id, case when length(text) <= 200 then text else substr(text, coalesce(greatest({_HINTS} - 50, 1), 1), 200) end as snippet from documents where text is not null
""",
    "json_terms": """
select event_id, case event_id % 3 when 0 then '{"terms": [{"term": "' || event_type || '"}], "meta": ' || props || '}' when 1 then '{"terms": []}' end as found from events
""",
    "gap_capture": """
with m as (
  select conv_id, turn, coalesce(text, '') || case when turn % 3 = 0 then chr(10) || '[Domain Knowledge] about ' || role || chr(10) || 'and [Domain Knowledge] ' || chr(10) else '' end as said from conversations
), e as (select conv_id, turn, trim(unnest(regexp_extract_all(said, '\\[Domain Knowledge\\](.*?)\\n', 1))) as entity from m)
select conv_id, turn, case when entity = '' then 'unspecified' else entity end as entity from e
""",
    "question_parts": """
with q as (select conv_id, turn, text, list_filter(list_transform(regexp_split_to_array(text, '[?;,]'), lambda p: trim(p, ' ')), lambda p: length(p) >= 3) as parts from conversations where text is not null)
select conv_id, turn, case when len(parts) > 0 then array_to_string(parts, '|') else text end as parts,
       cast(len(list_distinct(list_concat([lower(text)], list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda w: length(w) >= 3)))) as bigint) as n_entities from q
""",
    "text_forms": """
select p_partkey, p_name as plain, sha1(p_name)[1:16] as digest, 'doi_10_' || replace(p_name, ' ', '_') as safe, 'X' || p_size || '_' || regexp_replace(p_name, '[^A-Za-z0-9_]', '_', 'g') as class_id,
       array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), '') as scheme_id, case when p_partkey % 2 = 0 then p_name else p_brand end as label,
       lower(p_name) in ('red widget', 'small ring') or contains(' is a red widget or a small ring stronger ', ' ' || lower(p_name) || ' ') as named, p_name || ' ' || p_type as graph_text, true as formula_like,
       '(' || p_name || ') -[of]-> (' || p_type || ')' as triple, p_type as local, case when p_size > 9 then p_brand end as db
from part
""",
    "prompts": """
with s as (select 'Classes:' || chr(10) || string_agg('- ' || r_name || ': a region', chr(10) order by r_name) as schema_text from region)
select doc_id, sha256('Extract the scientific terms of the text as JSON.' || chr(10) || chr(10) || 'Schema:' || chr(10) || schema_text || chr(10) || chr(10) || 'Text:' || chr(10) || right(text, 8000)) as prompt_sha256,
       cast(length('Answer from the context; mark other knowledge as [Domain Knowledge].' || chr(10) || chr(10) || 'Context:' || chr(10) || schema_text || chr(10) || chr(10) || 'Question: ' || text) as bigint) as answer_chars
from documents, s where text is not null
""",
    "whole_talks": "select conv_id, string_agg(coalesce(text, ''), chr(10) order by turn) as text from conversations group by conv_id",
    "year_guess": f"""
with d as (
  select doc_id, coalesce(text, '') || chr(10) || 'Report of ' || (1990 + doc_id % 9) || ', published here. Volume 3 Issue ' || (1990 + doc_id % 5) || ' and then far away from any of these words and lines: 2003 2150 2003' || chr(10) || 'Received ' || (1998 + doc_id % 7) as text from documents
), v as (
  select doc_id, unnest(regexp_extract_all(text, '{_YEAR}')) as year, 1 as w from d
  union all select doc_id, year, {" + ".join(f"case when regexp_matches(span, '{w}', 'i') then 2 else 0 end" for w in years.NEAR_WORDS)} as w from (
    select doc_id, unnest(regexp_extract_all(text, '(.{{0,40}})({_YEAR})(.{{0,40}})', 0)) as span, unnest(regexp_extract_all(text, '(.{{0,40}})({_YEAR})(.{{0,40}})', 2)) as year from d)
), s as (select doc_id, cast(year as int) as year, sum(w) as w from v where cast(year as int) between 1900 and 2100 group by all)
select doc_id, cast(arg_max(year, w * 10000 + year) as int) as year from s group by doc_id
""",
    "file_years": "select o_orderkey, case when o_orderkey % 3 < 2 then cast(year(o_orderdate) as int) end as year from orders",
    "run_names": """
select o_orderkey, case o_orderkey % 4 when 0 then 'DeepSeek-R1-14B' when 1 then 'GPT-OSS-20B' when 2 then 'Qwen-3-235B' end as model, case when o_orderkey % 4 < 3 then cast(year(o_orderdate) - 1990 as int) end as papers from orders
""",
    "property_mentions": f"""
with k(phrase, property) as (values {_PHRASES}), g as (
  select p_partkey as page_id, p_name as material, lower(p_name) as m, replace(replace(replace({_MADE}[p_partkey % {len(SENTENCES)} + 1], '{{p}}', ['band gap', 'density', 'melting point'][p_partkey % 3 + 1]), '{{m}}', p_name), '{{n}}', cast(p_size as varchar)) as made from part
), s as (select page_id, material, m, unnest({_SENT.format("'An intro. ' || made || ' The end.'")}) as sentence from g
), h as (
  select * from s join k on contains(lower(sentence), phrase) where contains(lower(sentence), m) and abs(instr(lower(sentence), m) - instr(lower(sentence), phrase)) <= 30
    and (regexp_matches(lower(sentence), '\\b' || phrase || '\\b[ \\t\\n\\x0B\\f\\r]+of[ \\t\\n\\x0B\\f\\r]+' || m || '\\b') or regexp_matches(lower(sentence), '\\b' || m || '\\b[ \\t\\n\\x0B\\f\\r]+.*?\\b' || phrase || '\\b'))
), f as (
  select page_id, material, property, trim(sentence) as context, regexp_extract_all(sentence, '{properties.VALUE_UNIT}', 1) as v, regexp_extract_all(sentence, '{properties.VALUE_UNIT}', 2) as s, regexp_extract_all(sentence, '{properties.VALUE_UNIT}', 3) as u from h
)
select page_id, material, property, v[i] as raw_value, u[i] as raw_unit, nullif(s[i], '') as uncertainty, context, v[i] is not null as verified
from (select *, unnest(range(1, greatest(len(v), 1) + 1)) as i from f)
""",
    "formula_checks": f"""
with f as (select p_partkey, p_size, p_partkey % 8 as i, replace([{", ".join("null" if c is None else f"'{c}'" for c in CANONICAL)}][p_partkey % 8 + 1], '{{n}}', cast(p_size as varchar)) as canonical from part),
h as (select distinct canonical from f where i in (0, 2) or i = 4 and p_size % 2 = 0), k as (select f.*, h.canonical is not null as hit from f left join h using (canonical))
select p_partkey, canonical, cast(case when canonical is null then -1 when hit then 3 else 0 end as int) as mp_hits,
       case when canonical is null then 'invalid' when i = 4 and hit then 'ok' when i = 4 then 'invalid' else 'corrected' end as status from k
""",
    "ontology_lookup": """
with n as (
  select lower(label) as name, arg_max('X:' || p_partkey, p_partkey * 10 + place) as id from (
    select p_partkey, p_name as label, 0 as place from part where p_partkey % 3 > 0 union all select p_partkey, p_brand, 1 from part where p_partkey % 3 > 0) group by 1
)
select p_partkey, id as ontology_id from part left join n on name = lower(case when p_partkey % 2 = 0 then p_name else p_brand end)
""",
    "category_repair": "select n_nationkey, case when n_nationkey % 3 < 2 then r_name end as fixed from nation join region on n_regionkey = r_regionkey",
    "relation_validity": """
with s as (select s_suppkey, s_name, n_name, r_name from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey),
r as (select s.*, regexp_replace(s_name, '[02468]$', '1') as target from s)
select r.s_name as term, 'slot' || (r.s_suppkey % 4) as relation, target as related_term, o.n_name as target_category,
       case when o.s_name is null then r.s_suppkey % 7 > 0 else r.s_suppkey % 7 > 0 and (r.s_suppkey % 4 = 0 or (r.s_suppkey % 4 = 2 and r.r_name = 'ASIA')) end as verified
from r left join s o on o.s_name = target
""",
    "xrefs_by_source": "select user_id as id, event_type as db, string_agg(event_id, ',' order by cast(event_id as varchar)) as refs from events where event_id % 5 > 0 group by all",
    "edges_by_kind": """
select s_nationkey as id, coalesce(string_agg(s_name, ',' order by s_name) filter (where s_suppkey % 3 = 1), '') as roles, coalesce(string_agg(s_name, ',' order by s_name) filter (where s_suppkey % 3 = 0), '') as parents,
       coalesce(string_agg('part_of=' || s_name, ',' order by s_name) filter (where s_suppkey % 3 = 2), '') as others
from supplier group by s_nationkey
""",
    "path_length": f"""
with recursive {_EDGES}, b as (select subject as x, object as y from edges union select object, subject from edges), r as (
  select 'part:1' as id, 1 as nodes union select y, nodes + 1 from r join b on id = x where nodes < 6
)
select cast(min(nodes) as bigint) as nodes, 'part:1' as first, 'part:7' as last from r where id = 'part:7' having count(*) > 0
""",
    "isolated": f"""
with {_EDGES}, near as (select object as id from edges where subject = 'supplier:1' union select subject from edges where object = 'supplier:1' union select 'supplier:1')
select * from edges where subject in (select id from near) and object in (select id from near)
""",
    # RELATED_TO is all of 10 characters of rel:RELATED_TO (14); L, E, D and _ are what it shares with rel:SUPPLIED_BY (15).
    "additive_search": f"""
with {_EDGES}, w as (
  select subject, object, case when predicate = 'rel:RELATED_TO' then 1.2 else 1.5 end as w, case when predicate = 'rel:RELATED_TO' then (2 * 10 / 24) else (2 * 4 / 25) end as f from edges
), h0 as (select unnest(['part:1', 'part:2', 'part:3']) as id, cast(1 as double) as score),
h1 as (select object as id, max(score * w + f) as score from h0 join w on id = subject group by 1),
h2 as (select object as id, max(score * w + f / 2) as score from h1 join w on id = subject group by 1),
u as (select id, max(score) as score from (select * from h0 union all select * from h1 union all select * from h2) group by id order by score desc, id limit 12)
select id, round(score, 6) as score from u
""",
    "multi_query_seeds": """
with d as (
  select q.vec_id as query_id, e.vec_id, greatest(0, least(1, (list_sum(list_transform(range(1, len(e.embedding) + 1), lambda i: cast(e.embedding[i] as double) * cast(q.embedding[i] as double))) + 1) / 2)) as score
  from embeddings e, embeddings q where q.vec_id < 6
), top as (select *, row_number() over (partition by query_id order by score desc, 'part:' || vec_id) as place from d qualify place <= 12),
one as (select query_id, arg_min(vec_id, place) as vec_id, arg_min(score, place) as score from top join part on p_partkey = vec_id group by query_id, regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g'))
select 'part:' || vec_id as id, round(max(score), 6) as score from one group by vec_id
""",
    "label_search": "select p_partkey, p_name from part where contains(lower(p_name), 'ring') order by p_partkey limit 20",
    "bucket_25": "select 'p' || doc_id as paper, cast(ceil(row_number() over (order by 'p' || doc_id) / 25) * 25 as bigint) as bucket from documents",
    "first_buckets": "select 'p' || doc_id as paper, cast(ceil(row_number() over (order by 'p' || doc_id) / 25) * 25 as bigint) as bucket from documents qualify row_number() over (order by 'p' || doc_id) <= 100",
    "cumulative_checkpoint": """
with o as (select distinct cast(year(o_orderdate) as int) as b, o_custkey from orders)
select c.b as checkpoint, count(distinct o_custkey) as customers, count(*) as rows from (select distinct b from o) c join o on o.b <= c.b group by c.b
""",
    "filled_content": f"""
with {_MENTIONS}, f as (select m.* from m join (select key, min(ordinal) as o from m group by key) x using (key) where ordinal = o or chebi is not null)
select key, arg_min(chebi, ordinal) filter (where chebi is not null) as chebi, arg_min(formula, ordinal) filter (where formula is not null) as formula, arg_min(smiles, ordinal) filter (where smiles is not null) as smiles from f group by key
""",
    "merged_relations": f"with {_MENTIONS} select key, p_brand as relation, p_name as related_term, arg_min(p_size > 25, ordinal) as verified from m group by all",
    "older_merge": f"""
with {_MENTIONS}, p as (select key, paper, min(ordinal) as o from m group by all)
select a.key, pages, source_papers, total_occurrences, paper_count from (select key, array_to_string(list_sort(list(distinct page)), ',') as pages, count(*) as total_occurrences from m group by key) a
join (select key, string_agg(paper, ',' order by o) as source_papers, count(*) as paper_count from p group by key) b using (key)
""",
    "attached_properties": """
select lower(p_name) as key, p_type as property, case when p_size > 9 then p_size / 4 end as value, 'K' as unit, cast(0.5 as double) as uncertainty, p_brand as context, arg_min(p_size > 9, p_partkey) as verified
from part where lower(p_name) in (select lower(p_name) from part where p_partkey % 2 = 0) group by all
""",
    "relation_properties": """
with s as (select p_name, p_size, case p_partkey % 3 when 0 then ' Band Gap' when 1 then p_type else '' end as said from part)
select p_name as material, replace(lower(trim(said)), ' ', '_') as property, cast(null as varchar) as raw_value, cast(null as varchar) as raw_unit, cast(null as varchar) as uncertainty,
       'measured_property:' || said as context, p_size > 25 as verified from s
""",
    "run_counters": f"""
with {_MENTIONS} select (select count(distinct source) from documents) as files, (select count(*) from documents) as pages, count(distinct (paper, page)) as pages_with_terms, count(distinct key) as unique_terms from m
""",
    "node_content": f"""
with e as (
  select {_ID.format("case when p_partkey % 9 > 0 then p_name else p_brand end")} as id, case when p_partkey % 9 > 0 then p_name else p_brand end as name, p_brand as category, p_type as description, case when p_size > 25 then 'H2O' else '' end as formula, cast(p_size as varchar) as pages, p_brand as source_papers, p_partkey * 2 as k from part
  union all select {_ID.format("p_brand")}, p_brand, 'Unknown', '', '', '', '', p_partkey * 2 + 1 from part
)
select id, arg_min(name, k) as name, arg_min(category, k) as category, arg_min(description, k) as description, arg_min(formula, k) as formula, arg_min(pages, k) as pages, arg_min(source_papers, k) as source_papers from e group by id
""",
    "joined_evidence": f"""
with e as (select *, case when p_size > 20 then p_type || '; ' || p_brand when p_size > 10 then p_type end as t from part)
select {_ID.format("p_name")} as subject, case when p_size > 5 then 'rel:MADE_BY' else 'rel:RELATED_TO' end as predicate, {_ID.format("p_brand")} as object, arg_min_null(t, p_partkey) as has_evidence from e group by all
""",
    "answer_context": f"""
with {_EDGES}, names as (
  select 'part:' || p_partkey as id, p_name as name from part union all select 'supplier:' || s_suppkey, s_name from supplier union all select 'nation:' || n_nationkey, n_name from nation
), r as (
  select p_partkey % 5 as question_id, p_partkey as rank, 'part:' || p_partkey as id, p_name as name, p_type as category, p_size / 7 as score, case when p_size > 20 then p_brand else '' end as description, case when p_size > 30 then 'H2O' end as formula, [p_brand, 'none', 'Brand#1'] as papers
  from part
), o as (select question_id, rank, r.name, predicate, object, string_split(predicate, ':')[-1] as p, coalesce(n.name, object) as target from edges join r on subject = r.id left join names n on n.id = object
), facts as (
  select question_id, string_agg('(' || name || ') -[' || p || ']-> (' || target || ')', chr(10) order by rank, predicate, object) as t from (select * from o qualify row_number() over (partition by question_id order by rank, predicate, object) <= 150) group by question_id
), snips as (
  select question_id, rank, string_agg('[PDF ' || paper || ']' || chr(10) || snip, chr(10) order by place) as t from (
    select question_id, rank, place, paper, case when length(text) <= 1000 then text else substr(text, coalesce(greatest(list_min(list_filter([instr(lower(text), 'ieren'), instr(lower(text), 'ung ')], lambda i: i > 0)) - 250, 1), 1), 1000) end as snip
    from (select question_id, rank, unnest([1, 2, 3]) as place, unnest(papers) as paper from r) join (select 'Brand#' || doc_id as paper, coalesce(text, '') as text from documents) using (paper)
  ) where snip <> '' group by all
), rels as (select question_id, rank, string_agg('- ' || p || ': ' || target, chr(10) order by predicate, object) as t from o group by all
), s as (
  select r.question_id, r.rank, '## ' || r.name || ' (' || category || ')' || chr(10) || printf('Combined_Score: %.3f', score) || case when description <> '' then chr(10) || 'Description: ' || description else '' end
         || coalesce(chr(10) || 'Formula: ' || formula, '') || coalesce(chr(10) || snips.t, '') || coalesce(chr(10) || 'Relations:' || chr(10) || rels.t, '') as section
  from r left join snips using (question_id, rank) left join rels using (question_id, rank)
), h as (select question_id, 'Structured_KG_Facts:' || chr(10) || coalesce(t, '') as head from (select distinct question_id from r) left join facts using (question_id)
), k as (
  select *, length(head) + coalesce(sum(length(section)) over (partition by question_id order by rank rows between unbounded preceding and 1 preceding), 0) as prior, row_number() over (partition by question_id order by rank) as n from s join h using (question_id)
)
select question_id, head || chr(10) || chr(10) || string_agg(section, chr(10) || chr(10) order by rank) as context from k where prior < 4000 or n = 1 group by question_id, head
""",
    "class_hierarchy": f"with {_CLASSES} select * from classes",
    "narrower_inversion": f"""
with {_TRIPLES}, k as (select s from t where p = '{_RS}type') select s as child, o as parent from t where p = '{_SK}broader' and s in (from k) and o in (from k)
union select o, s from t where p = '{_SK}narrower' and s in (from k) and o in (from k)
""",
    "class_triples": f"""
with {_CLASSES} select 'urn:class:' || class as s, '{_RS}type' as p, '{skos.OWL}Class' as o from classes union all select 'urn:class:' || class, '{_OS}label', title from classes
union all select 'urn:class:' || class, '{_OS}comment', description from classes where description <> '' union all select 'urn:class:' || class, '{_OS}subClassOf', 'urn:class:' || parent from classes
""",
}
