"""Registered queries of dictionaries, similarity, vector index, checkpoints and inference, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import units
from graphloom.functions import text as T
from graphloom.operators import checkpoints, encoder, graph, inference, metrics, ontology, retrieval, skos, terms, vector_index
from graphloom.operators.steps import cut, fresh_folder
from graphloom.plans.queries import _ID, QUESTION, _query_vector, _relations, _t, _terms, _vectors, _whole_runs
from graphloom.sources import graph_json, turtle
from graphloom.streaming.incremental import TermStore

#: Places of the encoder's vectors.
PLACES = 128


def vector_index_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dozen nearest vectors, by the index, of each vector whose id is divisible by 100; its recall is tested against the exact scan."""
    rows = _t(spark, sf_dir, "embeddings")
    path, probes = vector_index.indexed(rows.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec")), 12)
    asked = rows.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    return vector_index.search(spark, path, asked, 12, probes)


def vector_top_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact twin of ``vector_index_top``: a scan of all vectors."""
    rows = _t(spark, sf_dir, "embeddings")
    asked = rows.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    out = retrieval.vector_top_each(rows.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec")), asked, 12)
    return out.withColumn("score", F.round("score", 6))


def encoded_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three texts nearest to each text whose id is divisible by 100, by hashed word weights."""
    docs = _t(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    made = cut(encoder.hashed_encoder(PLACES)(docs))
    asked = made.where("id % 100 = 0").select(F.col("id").alias("query_id"), F.col("vec").alias("query"))
    return retrieval.vector_top_each(made, asked, 3).withColumn("score", F.round("score", 5)).select("query_id", "score")


def _misspelt(name, key):
    """A part's name with a letter put before it, its first letter lost, two letters exchanged for others, or words that no part has."""
    at = F.length(name) - 3
    return (
        F.when(key % 5 == 0, F.concat(F.lit("q"), name))
        .when(key % 5 == 1, F.substring(name, F.lit(2), F.length(name)))
        .when(key % 5 == 2, F.concat(F.left(name, at), F.lit("zz"), F.right(name, F.lit(1))))
        .when(key % 5 == 3, F.upper(name))
        .otherwise(F.concat(F.lit("none "), key.cast("string")))
    )


def fuzzy_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Misspelt names of parts, repaired by the parts' names; most settle between a ratio of 80 and 100."""
    part = _t(spark, sf_dir, "part")
    names = part.groupBy(F.col("p_name").alias("name")).agg(F.min("p_partkey").cast("int").alias("pos"))
    asked = part.select("p_partkey", _misspelt(F.col("p_name"), F.col("p_partkey")).alias("category"))
    return ontology.repaired(asked, names, "category").select("p_partkey", "fixed")


def first_like_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first part whose name is like a misspelt one, by matching blocks."""
    part = _t(spark, sf_dir, "part")
    known = part.select(F.col("p_name").alias("name"), F.col("p_partkey").alias("ordinal"))
    return terms.first_like(part.select(_misspelt(F.col("p_name"), F.col("p_partkey")).alias("term")), known)


def _acronym(name):
    return F.upper(F.array_join(F.transform(F.split(name, " "), lambda w: F.left(w, F.lit(1))), ""))


def concept_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of parts in other spellings, with and as acronyms; many acronyms stand for several names."""
    n, name = F.col("p_partkey"), F.col("p_name")
    said = F.when(n % 4 == 0, F.upper(F.replace(name, F.lit(" "), F.lit("-")))).when(n % 4 == 1, F.concat(name, F.lit(" ("), _acronym(name), F.lit(")"))).when(n % 4 == 2, _acronym(name)).otherwise(name)
    rows = _t(spark, sf_dir, "part").select("p_partkey", said.alias("term"), n.alias("ordinal"))
    return terms.concepts(rows).select("p_partkey", "key")


def _full_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mention a part, some of them blank: its name is the term, its brand the paper; some say a relation twice, some have ontology data."""
    some = lambda n, c: F.when(F.col("p_partkey") % n == 0, F.concat(F.lit(c), "p_partkey"))
    relation = F.struct(F.col("p_brand").alias("relation"), F.col("p_type").alias("related_term"), (F.col("p_size") > 25).alias("verified"))
    said = F.when(F.col("p_partkey") % 2 == 0, F.array(relation)).when(F.col("p_partkey") % 7 == 0, F.array(relation, relation)).otherwise(F.array().cast("array<struct<relation:string,related_term:string,verified:boolean>>"))
    return _t(spark, sf_dir, "part").select(
        F.when(F.col("p_partkey") % 13 == 0, F.lit("  ")).otherwise(F.col("p_name")).alias("term"), F.col("p_type").alias("definition"), F.when(F.col("p_size") > 3, F.col("p_brand")).alias("category"), said.alias("relations"), F.concat(F.lit("s"), "p_partkey").alias("snippet"),
        F.col("p_brand").alias("paper"), F.col("p_size").alias("page"), F.col("p_partkey").alias("ordinal"), some(5, "c").alias("chebi"), some(3, "f").alias("formula"), some(10, "s").alias("smiles"),
    )


def _told(records: DataFrame) -> DataFrame:
    """Records with their lists as texts."""
    relation = lambda r: F.concat(r["relation"], F.lit(">"), r["related_term"], F.when(r["verified"], "!").otherwise(""))
    return records.select(
        "key", "term", "definition", "category", "chebi", "formula", "smiles", F.array_join(F.transform("relations", relation), ";").alias("relations"), F.array_join(F.col("pages").cast("array<string>"), ",").alias("pages"),
        F.array_join("source_papers", ",").alias("source_papers"), F.array_join(F.transform("context_snippets", lambda s: s["text"]), ",").alias("snippets"), "importance",
    )


def term_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _told(terms.records(_full_mentions(spark, sf_dir)))


def incremental_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records of a store to which the mentions came in two batches, the second of them twice."""
    rows = _full_mentions(spark, sf_dir)
    store = TermStore(spark, fresh_folder(spark, "terms"), 16)
    for even in (True, False, False):
        store.upsert(rows.where((F.col("ordinal") % 2 == 0) == F.lit(even)))
    return _told(store.records())


def running_checkpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers and rows up to each year, from a table with a partition a year."""
    rows = _t(spark, sf_dir, "orders").select(F.year("o_orderdate").alias("checkpoint"), "o_custkey").distinct()
    table = checkpoints.CheckpointTable(spark, fresh_folder(spark, "checkpoints"), ["o_custkey"])
    table.save(rows)
    return table.counts()


def slot_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What follows from suppliers and customers being part of nations, these of regions, and regions of the world."""
    fact = lambda s, o: [s.alias("s"), F.lit("part_of").alias("p"), o.alias("o")]
    at = lambda kind, key: F.concat(F.lit(f"{kind}:"), F.col(key).cast("string"))
    nation, region = _t(spark, sf_dir, "nation"), _t(spark, sf_dir, "region")
    given = _t(spark, sf_dir, "supplier").select(*fact(at("supplier", "s_suppkey"), at("nation", "s_nationkey")))
    given = given.union(_t(spark, sf_dir, "customer").select(*fact(at("customer", "c_custkey"), at("nation", "c_nationkey"))))
    given = given.union(nation.select(*fact(at("nation", "n_nationkey"), at("region", "n_regionkey")))).union(region.select(*fact(at("region", "r_regionkey"), F.lit("world"))))
    kinds = nation.select(at("nation", "n_nationkey").alias("s"), F.lit(inference.TYPE).alias("p"), F.lit("Nation").alias("o"))
    classes = spark.createDataFrame([("Nation", "Structure"), ("Structure", "NamedThing"), ("NamedThing", None)], "name string, is_a string")
    return inference.infer(given.union(kinds), inference.catalogue(spark), classes)


def rdf_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The customers of each nation, written as RDF lists and read back."""
    listed = F.array_sort(F.collect_list(F.struct("c_custkey", F.concat(F.lit("urn:customer:"), "c_custkey").alias("name"))))
    rows = _t(spark, sf_dir, "customer").groupBy(F.concat(F.lit("_:nation"), "c_nationkey").alias("list")).agg(listed.alias("c"))
    return skos.read_lists(cut(skos.lists(rows.select("list", F.col("c.name").alias("items")))))


def slot_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as slots, whose super-slots, domains and inverses come from the tables."""
    n = F.col("n_nationkey")
    rows = _t(spark, sf_dir, "nation").join(_t(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    slots = rows.select(
        F.col("n_name").alias("slot"), F.when(n % 3 > 0, F.col("r_name")).alias("domain"), F.when(n % 4 == 0, F.lit("xsd:float")).when(n % 4 == 1, F.col("r_name")).alias("range"),
        F.when(n % 5 == 0, F.col("r_name")).alias("inverse"), (n % 2 == 0).alias("symmetric"), (n % 6 == 0).alias("transitive"),
    )
    return skos.property_triples(slots)


def turtle_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations and their suppliers, written as Turtle files and read back."""
    rows = _t(spark, sf_dir, "supplier").join(_t(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    named = F.concat(F.lit("s:"), "s_suppkey", F.lit(' a s:Supplier ; s:name """'), "s_name", F.lit('"""@en ; s:of [ s:nation "'), "n_name", F.lit('" ] .'))
    files = rows.groupBy("n_nationkey").agg(F.concat(F.lit("@prefix s: <urn:s:> .\n"), F.array_join(F.array_sort(F.collect_list(named)), "\n")).alias("value"))
    path = fresh_folder(spark, "turtle")
    files.select("value").write.option("maxRecordsPerFile", 1).text(path)
    found, _ = turtle.read_turtle(spark, f"{path}/*.txt")
    cutoff = F.when(F.col("s").startswith("_:"), "_:").otherwise(F.col("s"))
    return found.select(cutoff.alias("s"), "p", F.when(F.col("o").startswith("_:"), "_:").otherwise(F.col("o")).alias("o"))


def unit_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every rule of the units, and units without one, on the parts' sizes and prices."""
    pairs = [(p, u) for p, named, *_ in units.RULES for u in (named or ["odd"])] + [("density", "none"), ("unheard", "foo")]
    at = (F.col("p_partkey") % len(pairs) + 1).cast("int")
    pick = lambda i: F.element_at(F.array(*(F.lit(p[i]) for p in pairs)), at)
    value = F.when(F.col("p_partkey") % 11 == 0, F.lit(None)).when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("-"), "p_size")).otherwise(F.col("p_size").cast("string"))
    rows = _t(spark, sf_dir, "part").select("p_partkey", pick(0).alias("property"), value.alias("raw_value"), F.concat(F.lit(" "), F.upper(pick(1))).alias("raw_unit"), F.lit("2").alias("uncertainty"))
    return units.normalize(rows).select("p_partkey", "normalized_value", F.trim("normalized_unit").alias("normalized_unit"), "uncertainty_value", "unit_conversion_failed")


def obo_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts written as ontology entries and read back."""
    part = _t(spark, sf_dir, "part")
    line = lambda *xs: F.concat(*(F.lit(x) if isinstance(x, str) else x for x in xs), F.lit("\n"))
    value = lambda name, of: line(f'property_value: http://purl.obolibrary.org/obo/chebi/{name} "', of, '"^^xsd:string')
    stanza = F.concat(line("[Term]"), line("id: P:", F.col("p_partkey")), line("name: ", F.col("p_name")), line("xref: B:", F.substring_index("p_brand", "#", -1)), value("mass", F.lit("0")), value("mass", F.col("p_size")), value("smiles", F.col("p_type")), line("relationship: has_part P:", F.col("p_size")))
    path = fresh_folder(spark, "obo")
    part.select(stanza.alias("value")).write.text(path)
    found = graph_json.read_obo(spark, path)
    return found.select("id", "name", "mass", "charge", "smiles", F.array_join("xrefs", ",").alias("xrefs"), F.array_join(F.transform("relationships", lambda r: F.concat(r["predicate"], F.lit("="), r["target"])), ",").alias("relationships"))


def long_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The terms object of replies that hold whole documents, nested three deep, between texts with stray braces."""
    bare = F.regexp_replace(F.coalesce("text", F.lit("")), r'[{}"\\\x00-\x1f]', " ")
    found = F.concat(F.lit('{"terms": [{"term": "'), bare, F.lit('", "r": [{"k": 1}]}]}'))
    reply = F.concat(F.lit("Sure {} "), found, F.lit(" and { more"))
    return _t(spark, sf_dir, "documents").select("doc_id", F.sha2(T.terms_object(reply).cast("binary"), 256).alias("found_sha256"))


def saved_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records of half of the mentions, saved as JSON documents, read back and continued with the other half."""
    rows = _full_mentions(spark, sf_dir)
    size = rows.count() // 2
    path = fresh_folder(spark, "saved")
    graph_json.export_terms(terms.records(rows.where(F.col("ordinal") <= size)).drop("ordinal"), path, 20)
    saved = terms.as_mentions(graph_json.read_terms(spark, f"{path}/part-*")).drop("key")
    return _told(terms.records(saved.unionByName(rows.where(F.col("ordinal") > size), allowMissingColumns=True)))


def graph_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The graph of parts and brands, written as JSON documents and read back: its edges with their ends' names."""
    things, links = graph.build(_terms(spark, sf_dir), _relations(spark, sf_dir))
    path = fresh_folder(spark, "graph")
    graph_json.export_graph(things, links, path, 200)
    things, links = graph_json.read_graph(spark, f"{path}/part-*")
    name = lambda end: things.select(F.col("id").alias(end), F.col("name").alias(f"{end}_name"))
    return links.join(name("subject"), "subject").join(name("object"), "object").select("subject_name", "predicate", "object_name", "has_evidence")


def triples_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts' names and types with marks that need escapes, written as N-Triples and read back."""
    literal = F.concat(F.lit('a "'), "p_name", F.lit('" \\ '), "p_type")
    rows = _t(spark, sf_dir, "part").select(F.concat(F.lit("urn:part:"), "p_partkey").alias("s"), F.lit("urn:says").alias("p"), F.when(F.col("p_partkey") % 2 == 0, literal).otherwise(F.concat(F.lit("urn:size:"), "p_size")).alias("o"))
    path = fresh_folder(spark, "triples")
    graph_json.write_triples(rows, path)
    return graph_json.read_triples(spark, path)


def gap_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps of conversations, appended to a log in two batches: how often each is in it, and whether all have a time."""
    rows = _t(spark, sf_dir, "conversations").select(F.col("role").alias("query"), F.concat(F.lit("gap "), F.col("turn") % 5).alias("entity"), F.lit("not found").alias("reason"), "conv_id")
    path = fresh_folder(spark, "gaps")
    for even in (True, False):
        graph_json.append_gaps(rows.where((F.col("conv_id") % 2 == 0) == F.lit(even)).drop("conv_id"), path)
    return spark.read.json(path).groupBy("query", "entity").agg(F.count("*").alias("n"), F.bool_and(F.col("timestamp") > 1e9).alias("timed"))


def questions_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions read from lines, of which some are blank."""
    line = F.when(F.col("p_partkey") % 4 == 0, F.lit("  ")).otherwise(F.concat(F.lit(" What is "), "p_name", F.lit("? ")))
    path = fresh_folder(spark, "questions")
    _t(spark, sf_dir, "part").select(line.alias("value")).write.text(path)
    return graph_json.read_questions(spark, path).groupBy("question").agg(F.count("*").alias("n"))


def runs_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The figures of runs, written as CSV with a header and read back."""
    path = fresh_folder(spark, "csv")
    graph_json.write_table(metrics.structure(*_whole_runs(spark, sf_dir)), path)
    found = spark.read.option("header", True).csv(path)
    return found.select("model", F.col("papers").cast("int").alias("papers"), F.col("entities").cast("long").alias("entities"), F.col("relations").cast("long").alias("relations"))


def grouped_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers by nation, written as JSON lines with a list each and read back; answers are appended beside them in two batches."""
    rows = _t(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nation"), "s_suppkey", "s_name")
    path = fresh_folder(spark, "grouped")
    graph_json.write_grouped(rows, "nation", f"{path}/lists")
    for even in (True, False):
        graph_json.append_answers(rows.where((F.col("s_suppkey") % 2 == 0) == F.lit(even)), f"{path}/answers")
    lists = spark.read.json(f"{path}/lists").select("nation", F.array_join(F.transform("rows", lambda r: r["s_name"]), ",").alias("names"))
    counted = spark.read.json(f"{path}/answers").groupBy(F.col("nation").alias("of")).agg(F.count("*").alias("answers"))
    return lists.join(counted, F.col("nation") == F.col("of")).select("nation", "names", "answers")


def relation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relations of parts, misspelt like their names, repaired by those names as slots; some are called description or category."""
    part = _t(spark, sf_dir, "part")
    slots = part.groupBy(F.col("p_name").alias("name")).agg(F.min("p_partkey").cast("int").alias("pos"))
    said = F.when(F.col("p_partkey") % 9 == 0, F.lit(" Description")).when(F.col("p_partkey") % 9 == 1, F.lit("category")).otherwise(_misspelt(F.col("p_name"), F.col("p_partkey")))
    rows = part.select("p_partkey", said.alias("relation"), F.concat(F.lit(" "), "p_brand").alias("related_term"))
    return ontology.repaired_relations(rows, slots).select("p_partkey", "relation", "related_term", "verified")


def reranked_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five of a question's best hits whose names stand in it or whose words are most like it."""
    part = _t(spark, sf_dir, "part").select(F.concat(F.lit("part:"), "p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("description"))
    hits = retrieval.vector_top(_vectors(spark, sf_dir), _query_vector(spark, sf_dir), 48)
    return retrieval.reranked(hits, part, QUESTION, 5).select("id", "exact", F.round("fuzzy", 6).alias("fuzzy"))


QUERIES = {f.__name__: f for f in [vector_index_top, vector_top_many, encoded_neighbours, fuzzy_repair, first_like_names, concept_keys, term_records, incremental_resume, running_checkpoints, slot_inference, rdf_lists, slot_triples, turtle_parts, unit_rules, obo_entries, long_replies, saved_records, graph_documents, triples_file, gap_log, questions_file, runs_csv, grouped_rows, relation_repair, reranked_hits]}

_MISSPELT = "case p_partkey % 5 when 0 then 'q' || p_name when 1 then substr(p_name, 2) when 2 then left(p_name, length(p_name) - 3) || 'zz' || right(p_name, 1) when 3 then upper(p_name) else 'none ' || p_partkey end"
#: Bits of the characters of a that equal x, and the length of the longest common subsequence of a and b by them (Hyyrö's recurrence); names are shorter than 60 characters.
_BITS = "coalesce(list_sum(list_transform(range(length(a)), lambda i: case when substr(a, cast(i + 1 as int), 1) = x then cast(1 as hugeint) << cast(i as int) else 0 end)), 0)"
_LCS = f"""length(a) - bit_count(cast(list_reduce(list_prepend((cast(1 as hugeint) << length(a)) - 1, list_transform(string_split(b, ''), lambda x: cast({_BITS} as hugeint))),
  lambda v, m: ((v + (v & m)) | (v - (v & m))) & ((cast(1 as hugeint) << length(a)) - 1)) as bit))"""
_REPAIR = f"""
with names as (select p_name as name, min(p_partkey) as pos from part group by 1), asked as (select p_partkey, {_MISSPELT} as category from part),
pairs as (select category, lower(category) as a, lower(name) as b, name, pos from (select distinct category from asked) cross join names where abs(length(category) - length(name)) <= (length(category) + length(name)) * 0.2 + 1),
scored as (select category, name, pos, 200.0 * ({_LCS}) / (length(a) + length(b)) as score from pairs),
best as (select category, arg_max(name, score * 1000000 - pos / 1000000.0) as fixed from scored where score >= 80 group by category)"""
_MENTIONS = """m as (
  select p_name as term, lower(trim(p_name)) as key, p_type as definition, case when p_size > 3 then p_brand end as category, p_brand as paper, p_size as page, p_partkey as ordinal, 's' || p_partkey as snippet,
         case when p_partkey % 5 = 0 then 'c' || p_partkey end as chebi, case when p_partkey % 3 = 0 then 'f' || p_partkey end as formula, case when p_partkey % 10 = 0 then 's' || p_partkey end as smiles,
         p_brand || '>' || p_type || case when p_size > 25 then '!' else '' end as said, p_brand || '>' || p_type as pair, case when p_partkey % 2 = 0 then 1 when p_partkey % 7 = 0 then 2 else 0 end as times from part where p_partkey % 13 > 0
)"""
_RECORDS = f"""
with {_MENTIONS}, firsts as (select key, min(ordinal) as o from m group by key), chem as (select m.* from m join firsts using (key) where ordinal = o or chebi is not null),
c as (select key, arg_min(chebi, ordinal) filter (where chebi is not null) as chebi, arg_min(formula, ordinal) filter (where formula is not null) as formula, arg_min(smiles, ordinal) filter (where smiles is not null) as smiles from chem group by key),
r as (select key, said, times, ordinal from m where times > 0 qualify row_number() over (partition by key, pair order by ordinal) = 1),
rel as (select key, string_agg(case when times = 2 then said || ';' || said else said end, ';' order by ordinal) as relations from r group by key),
p as (select * from m qualify row_number() over (partition by key, page order by ordinal) = 1),
pg as (select key, string_agg(page, ',' order by ordinal) as pages, string_agg(paper, ',' order by ordinal) as source_papers, string_agg(snippet, ',' order by ordinal) as snippets, count(*) as occ, count(distinct paper) as papers from p group by key),
h as (select key, arg_min(term, ordinal) as term, arg_max(definition, length(definition) * 100000000 - ordinal) as definition, coalesce(arg_min_null(category, ordinal), 'Thing') as category from m group by key)
select key, term, definition, category, chebi, formula, smiles, coalesce(relations, '') as relations, pages, source_papers, snippets, case when papers > 1 or occ > 5 then 'high' when occ > 2 then 'medium' else 'low' end as importance
from h join c using (key) join pg using (key) left join rel using (key)
"""
_UNIT_ROWS = ", ".join(f"({i}, '{p}', '{u}', {s!r}, {o!r}, '{t}')" for i, (p, u, s, o, t) in enumerate([(p, u, s, o, t) for p, named, s, o, t in units.RULES for u in (named or ["odd"])]))
_UNIT_COUNT = sum(len(r[1] or ["odd"]) for r in units.RULES)
_UNIT_RANGES = " ".join(f"when property = '{p}' then v between {low} and {1e300 if high == float('inf') else high}" for p, (low, high) in units.RANGES.items())
_S = "urn:class:"

ORACLE_SQL = {
    "vector_top_many": """
select query_id, id, score from (
  select q.vec_id as query_id, e.vec_id as id, greatest(0, least(1, (list_sum(list_transform(range(1, len(e.embedding) + 1), lambda i: cast(e.embedding[i] as double) * cast(q.embedding[i] as double))) + 1) / 2)) as s, round(s, 6) as score
  from embeddings e, embeddings q where q.vec_id % 100 = 0
) qualify row_number() over (partition by query_id order by s desc, id) <= 12
""",
    "encoded_neighbours": f"""
with w as (select doc_id as id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')) as word from documents),
n as (select id, cast('0x' || substr(md5(word), 1, 8) as bigint) % {PLACES} as place, count(*) as n from w group by all),
i as (select place, ln((1.0 + (select count(*) from documents)) / (count(*) + 1)) + 1 as idf from n group by place),
x as (select id, place, n * idf as w from n join i using (place)), s as (select id, sqrt(sum(w * w)) as size from x group by id),
u as (select id, place, w / size as w from x join s using (id)),
d as (select q.id as query_id, e.id, sum(q.w * e.w) as dot from u q join u e using (place) where q.id % 100 = 0 group by all),
every as (select q.doc_id as query_id, e.doc_id as id, greatest(0, least(1, (coalesce(dot, 0) + 1) / 2)) as s from documents q cross join documents e left join d on d.query_id = q.doc_id and d.id = e.doc_id where q.doc_id % 100 = 0)
select query_id, round(s, 5) as score from every qualify row_number() over (partition by query_id order by s desc, id) <= 3
""",
    "fuzzy_repair": f"{_REPAIR} select p_partkey, fixed from asked left join best using (category)",
    "relation_repair": f"""
{_REPAIR} select a.p_partkey, case when fixed is null then category else fixed end as relation, p_brand as related_term, fixed is not null as verified
from asked a join part p on p.p_partkey = a.p_partkey left join best using (category) where a.p_partkey % 9 > 1
""",
    "concept_keys": """
with t as (
  select p_partkey, p_name, array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1])), '') as acr from part
), said as (
  select *, case p_partkey % 4 when 0 then upper(replace(p_name, ' ', '-')) when 1 then p_name || ' (' || acr || ')' when 2 then acr else p_name end as term from t
), pairs as (select acr, min(p_name) as only_name, count(distinct p_name) as n from said where p_partkey % 4 = 1 and length(acr) >= 2 group by acr),
c as (
  select p_partkey, term, case when p_partkey % 4 <> 2 then 'n' || p_name when n = 1 then 'n' || only_name else 'a' || s.acr end as concept from said s left join pairs p on p.acr = s.acr
)
select p_partkey, first_value(lower(term)) over (partition by concept order by p_partkey) as key from c
""",
    "term_records": _RECORDS,
    "incremental_resume": _RECORDS,
    "saved_records": _RECORDS,
    "reranked_hits": f"""
with hits as (
  select 'part:' || e.vec_id as id, greatest(0, least(1, (list_sum(list_transform(range(1, len(e.embedding) + 1), lambda i: cast(e.embedding[i] as double) * cast(q.embedding[i] as double))) + 1) / 2)) as score
  from embeddings e, (select embedding from embeddings where vec_id = 0) q order by score desc, id limit 30
), n as (
  select id, score, cast(contains(' ' || lower('{QUESTION}') || ' ', ' ' || lower(p_name) || ' ') as int) as exact, list_distinct(string_split('{QUESTION}', ' ')) as x, list_distinct(string_split(p_name || ' ' || p_type, ' ')) as y
  from hits join part on id = 'part:' || p_partkey
), w as (
  select *, array_to_string(list_sort(list_intersect(x, y)), ' ') as shared, array_to_string(list_sort(list_filter(x, lambda v: not list_contains(y, v))), ' ') as l, array_to_string(list_sort(list_filter(y, lambda v: not list_contains(x, v))), ' ') as r from n
), p as (
  select id, score, exact, shared, l, r, trim(shared || ' ' || l) as a, trim(shared || ' ' || r) as b from w union all select id, score, exact, shared, l, r, shared, trim(shared || ' ' || l) from w union all select id, score, exact, shared, l, r, shared, trim(shared || ' ' || r) from w
), s as (select id, score, exact, case when shared <> '' and (l = '' or r = '') then 100.0 when a = '' or b = '' then 0.0 else 200.0 * ({_LCS}) / (length(a) + length(b)) end as ratio from p),
f as (select id, score, exact, max(ratio) as fuzzy from s group by all)
select id, exact, round(fuzzy, 6) as fuzzy from f order by exact desc, fuzzy desc, score desc, id limit 5
""",
    "graph_documents": f"""
with named as (select {_ID.format("name")} as id, arg_min(name, k) as name from (select p_name as name, p_partkey * 2 as k from part union all select p_brand, p_partkey * 2 + 1 from part) group by 1),
e as (select {_ID.format("p_name")} as s, {_ID.format("p_brand")} as o, arg_min(p_type, p_partkey) as t from part group by all)
select a.name as subject_name, 'rel:BRANDED' as predicate, b.name as object_name, t as has_evidence from e join named a on a.id = s join named b on b.id = o
""",
    "triples_file": "select 'urn:part:' || p_partkey as s, 'urn:says' as p, case when p_partkey % 2 = 0 then 'a \"' || p_name || '\" \\ ' || p_type else 'urn:size:' || p_size end as o from part",
    "gap_log": "select role as query, 'gap ' || (turn % 5) as entity, count(*) as n, true as timed from conversations group by all",
    "questions_file": "select 'What is ' || p_name || '?' as question, count(*) as n from part where p_partkey % 4 > 0 group by all",
    "runs_csv": "select o_orderpriority as model, cast(year(o_orderdate) - 1900 as int) as papers, count(distinct o_custkey) as entities, count(distinct (o_custkey, o_orderstatus, o_orderkey)) as relations from orders group by all",
    "grouped_rows": "select cast(s_nationkey as bigint) as nation, string_agg(s_name, ',' order by s_suppkey) as names, count(*) as answers from supplier group by s_nationkey",
    "running_checkpoints": """
with o as (select distinct cast(year(o_orderdate) as int) as b, o_custkey from orders)
select c.b as checkpoint, count(distinct o_custkey) as keys, count(*) as rows from (select distinct b from o) c join o on o.b <= c.b group by c.b
""",
    "slot_inference": """
with recursive base(s, o) as (
  select 'supplier:' || s_suppkey, 'nation:' || s_nationkey from supplier union all select 'customer:' || c_custkey, 'nation:' || c_nationkey from customer
  union all select 'nation:' || n_nationkey, 'region:' || n_regionkey from nation union all select 'region:' || r_regionkey, 'world' from region
), up(s, o) as (select * from base union select up.s, base.o from up join base on up.o = base.s)
select s, unnest(['part_of', 'physically_related_to', 'related_to']) as p, o from up union select o, unnest(['has_component', 'physically_related_to', 'related_to']), s from up
union select 'nation:' || n_nationkey, 'type', unnest(['Nation', 'Structure', 'NamedThing']) from nation
""",
    "rdf_lists": "select '_:nation' || c_nationkey as list, cast(row_number() over (partition by c_nationkey order by c_custkey) - 1 as int) as place, 'urn:customer:' || c_custkey as item from customer",
    "slot_triples": f"""
with t as (select n_name, r_name, n_nationkey as n from nation join region on n_regionkey = r_regionkey)
select '{_S}' || n_name as s, '{skos.RDF}type' as p, '{skos.OWL}' || case when n % 4 = 0 then 'DatatypeProperty' else 'ObjectProperty' end as o from t
union all select '{_S}' || n_name, '{skos.RDFS}label', n_name from t union all select '{_S}' || n_name, '{skos.RDFS}domain', '{_S}' || r_name from t where n % 3 > 0
union all select '{_S}' || n_name, '{skos.RDFS}range', case n % 4 when 0 then 'http://www.w3.org/2001/XMLSchema#float' else '{_S}' || r_name end from t where n % 4 < 2
union all select '{_S}' || n_name, '{skos.OWL}inverseOf', '{_S}' || r_name from t where n % 5 = 0
union all select '{_S}' || n_name, '{skos.RDF}type', '{skos.OWL}SymmetricProperty' from t where n % 2 = 0 union all select '{_S}' || n_name, '{skos.RDF}type', '{skos.OWL}TransitiveProperty' from t where n % 6 = 0
""",
    "turtle_parts": f"""
with t as (select 'urn:s:' || s_suppkey as s, s_name, n_name from supplier join nation on s_nationkey = n_nationkey)
select s, '{skos.RDF}type' as p, 'urn:s:Supplier' as o from t union all select s, 'urn:s:name', s_name from t union all select s, 'urn:s:of', '_:' from t union all select '_:', 'urn:s:nation', n_name from t
""",
    "unit_rules": f"""
with r(i, property, unit, factor, shift, target) as (values {_UNIT_ROWS}), a as (
  select p_partkey, p_partkey % {_UNIT_COUNT + 2} as i, case when p_partkey % 11 = 0 then null when p_partkey % 3 = 0 then -p_size else p_size end as raw from part
), j as (
  select p_partkey, a.i, raw, coalesce(property, case when a.i = {_UNIT_COUNT} then 'density' else 'unheard' end) as property, coalesce(factor, case when a.i > {_UNIT_COUNT} then 1.0 end) as factor, coalesce(target, case when a.i > {_UNIT_COUNT} then 'FOO' end) as target,
         round(raw * coalesce(factor, case when a.i > {_UNIT_COUNT} then 1.0 end) + coalesce(shift, 0), 6) as v from a left join r on a.i = r.i
), k as (select *, coalesce(v is not null and (case {_UNIT_RANGES} else true end), false) as good from j)
select p_partkey, case when good then cast(v as double) end as normalized_value, case when good then target end as normalized_unit, case when good then cast(round(2 * factor, 6) as double) end as uncertainty_value, raw is not null and not good as unit_conversion_failed from k
""",
    "obo_entries": "select 'P:' || p_partkey as id, p_name as name, cast(p_size as varchar) as mass, cast(null as varchar) as charge, string_split(p_type, ' ')[1] as smiles, 'B:' || string_split(p_brand, '#')[-1] as xrefs, 'has_part=P:' || p_size as relationships from part",
    "long_replies": """
select doc_id, sha256('{"terms": [{"term": "' || regexp_replace(coalesce(text, ''), '[{}"\\\\\\x00-\\x1f]', ' ', 'g') || '", "r": [{"k": 1}]}]}') as found_sha256 from documents
""",
}
