"""Registered queries over the driver's tables, and SQL that gives the same rows.

Parts, suppliers and nations stand for things; what supplies what is the
edges; order years are checkpoints; documents are pages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import text as T
from graphloom.functions import units
from graphloom.operators import checkpoints, graph, metrics, properties, retrieval, terms, years

QUESTION = "Which small green device, or part, contains steel?"


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def things(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = _t(spark, sf_dir, "part").select(F.concat(F.lit("part:"), "p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("description"), F.array(F.col("p_brand")).alias("source_papers"))
    supplier = _t(spark, sf_dir, "supplier").select(F.concat(F.lit("supplier:"), "s_suppkey").alias("id"), F.col("s_name").alias("name"), F.lit("").alias("description"), F.array().cast("array<string>").alias("source_papers"))
    nation = _t(spark, sf_dir, "nation").select(F.concat(F.lit("nation:"), "n_nationkey").alias("id"), F.col("n_name").alias("name"), F.lit("").alias("description"), F.array().cast("array<string>").alias("source_papers"))
    return part.unionByName(supplier).unionByName(nation)


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    supplied = _t(spark, sf_dir, "lineitem").select(F.concat(F.lit("part:"), "l_partkey").alias("subject"), F.lit("rel:SUPPLIED_BY").alias("predicate"), F.concat(F.lit("supplier:"), "l_suppkey").alias("object")).distinct()
    lives = _t(spark, sf_dir, "supplier").select(F.concat(F.lit("supplier:"), "s_suppkey").alias("subject"), F.lit("rel:RELATED_TO").alias("predicate"), F.concat(F.lit("nation:"), "s_nationkey").alias("object"))
    return supplied.unionByName(lives)


def _query_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    return _t(spark, sf_dir, "embeddings").where("vec_id = 0").select("embedding").first()[0]


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "embeddings").select(F.concat(F.lit("part:"), "vec_id").alias("id"), F.col("embedding").alias("vec"))


def retrieve_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = retrieval.ranked(things(spark, sf_dir), edges(spark, sf_dir), _vectors(spark, sf_dir), QUESTION, _query_vector(spark, sf_dir), hops=2)
    return out.select("id", "name", *(F.round(c, 6).alias(c) for c in ("score_sem", "score_graph", "lexical_overlap", "score_prp")), F.col("depth").cast("long").alias("depth"), "evidence_ct")


def vector_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.vector_top(_vectors(spark, sf_dir), _query_vector(spark, sf_dir), 24).select("id", F.round("score", 6).alias("score"))


def context_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "conversations").select("conv_id", F.struct("turn", "role", "text").alias("rank"), F.coalesce("text", F.lit("")).alias("section"))
    return retrieval.budgeted(rows, "conv_id", 300).select("conv_id", F.col("rank.turn").alias("turn"), F.col("prior").cast("long").alias("prior"), F.length("section").cast("long").alias("chars"))


def graph_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.degree(edges(spark, sf_dir))


def graph_strong(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.strong(edges(spark, sf_dir))


def graph_k_hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    seeds = spark.range(1, 3).select(F.concat(F.lit("part:"), "id").alias("id"))
    return graph.k_hop(edges(spark, sf_dir), seeds, 4)


def _terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "part").select(F.col("p_name").alias("term"), F.col("p_brand").alias("category"), F.col("p_type").alias("definition"), F.col("p_partkey").alias("ordinal"))


def _relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = _t(spark, sf_dir, "part")
    return part.select(F.col("p_name").alias("term"), F.lit("BRANDED").alias("relation"), F.col("p_brand").alias("related_term"), F.col("p_type").alias("evidence"), F.col("p_partkey").alias("ordinal"))


def graph_things(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.build(_terms(spark, sf_dir), _relations(spark, sf_dir))[0]


def graph_associations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.build(_terms(spark, sf_dir), _relations(spark, sf_dir))[1]


def schema_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = _t(spark, sf_dir, "nation").join(_t(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    tree = nation.select(F.col("n_name").alias("name"), F.col("r_name").alias("is_a")).union(_t(spark, sf_dir, "region").select("r_name", F.lit("Thing"))).union(spark.createDataFrame([("Thing", None)], "name string, is_a string"))
    return graph.closure(tree)


def merge_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "part").select(F.col("p_type").alias("term"), F.col("p_name").alias("definition"), F.col("p_brand").alias("category"), F.col("p_brand").alias("paper"), F.col("p_size").alias("page"), F.col("p_partkey").alias("ordinal"))
    out = terms.merge_mentions(rows)
    return out.select("key", "term", "category", "definition", F.array_join(F.col("pages").cast("array<string>"), ",").alias("pages"), F.array_join("source_papers", ",").alias("source_papers"), "importance")


def usable_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return terms.usable_pages(_t(spark, sf_dir, "documents")).select("doc_id")


def term_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.col("p_name")
    return _t(spark, sf_dir, "part").select("p_partkey", T.normalize_term(name).alias("normal"), T.canonical_key(name).alias("canonical"), T.make_id(name).alias("node_id"), T.is_generic(name).alias("generic"), F.array_join(T.tokens(name), " ").alias("tokens"))


def snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "documents").select("doc_id", F.size(T.sentences(F.coalesce("text", F.lit("")))).cast("long").alias("n_sentences"))


def mine_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = _t(spark, sf_dir, "part")
    pages = part.select(F.col("p_partkey").alias("page_id"), F.concat(F.lit("Intro text. The density of mat is "), F.col("p_size"), F.lit(".5 g/cm3. None here.")).alias("text"))
    return properties.mine(pages, part.select(F.col("p_partkey").alias("page_id"), F.lit("mat").alias("material"))).drop("no", "uncertainty")


def normalize_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "part").select(
        "p_partkey",
        F.element_at(F.array(*map(F.lit, ["density", "band_gap", "melting_point", "efficiency", "unheard"])), (F.col("p_partkey") % 5 + 1).cast("int")).alias("property"),
        F.col("p_size").cast("string").alias("raw_value"),
        F.element_at(F.array(*map(F.lit, ["g/cm3", "eV", "°C", "%", "foo"])), (F.col("p_partkey") % 5 + 1).cast("int")).alias("raw_unit"),
        F.lit("1").alias("uncertainty"),
    )
    return units.normalize(rows).drop("raw_value", "raw_unit", "uncertainty", "property")


def _runs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    orders = _t(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("model"), (F.year("o_orderdate") - 1900).alias("papers"), F.concat(F.lit("c"), F.col("o_custkey") % 700).alias("id"), F.col("o_orderstatus").alias("predicate"), F.concat(F.lit("c"), F.col("o_orderkey") % 900).alias("object"))
    return orders.select("model", "papers", "id"), orders.select("model", "papers", F.col("id").alias("subject"), "predicate", "object")


def _whole_runs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """As _runs, but every customer and order is an entity of its own, so the graph grows with orders."""
    orders = _t(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("model"), (F.year("o_orderdate") - 1900).alias("papers"), F.concat(F.lit("c"), F.col("o_custkey")).alias("id"), F.col("o_orderstatus").alias("predicate"), F.concat(F.lit("c"), F.col("o_orderkey")).alias("object"))
    return orders.select("model", "papers", "id"), orders.select("model", "papers", F.col("id").alias("subject"), "predicate", "object")


def graph_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.structure(*_runs(spark, sf_dir))


def graph_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.growth(_runs(spark, sf_dir)[0])


def graph_structure_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.structure(*_whole_runs(spark, sf_dir))


def graph_growth_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.growth(_whole_runs(spark, sf_dir)[0])


def year_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.concat(F.lit("Seen 1998. Published "), F.year("o_orderdate"), F.lit(". No 2150.")).alias("text"))
    return years.vote(rows, 2100)


def best_per_node(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best score of each node over sub-queries."""
    hits = _t(spark, sf_dir, "events").select(F.col("user_id").alias("id"), F.col("value").alias("score"), "event_type")
    return retrieval.merged_seeds(*(hits.where(F.col("event_type") == kind) for kind in ("click", "error", "purchase", "signup", "view"))).withColumnRenamed("id", "user_id")


def last_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest run of each model, with its figures."""
    runs = metrics.structure(*_whole_runs(spark, sf_dir))
    return checkpoints.last_run(runs).select("model", "papers", "entities", "relations")


QUERIES = {f.__name__: f for f in [retrieve_ranked, vector_top, context_budget, graph_degree, graph_strong, graph_k_hop, graph_things, graph_associations, schema_closure, merge_terms, usable_pages, term_keys, snippets, mine_properties, normalize_units, graph_structure, graph_growth, graph_structure_whole, graph_growth_whole, year_votes, best_per_node, last_runs]}

_EDGES = """edges as (
  select distinct 'part:' || l_partkey as subject, 'rel:SUPPLIED_BY' as predicate, 'supplier:' || l_suppkey as object from lineitem
  union all select 'supplier:' || s_suppkey, 'rel:RELATED_TO', 'nation:' || s_nationkey from supplier
)"""
_VECTOR = """hits as (
  select 'part:' || e.vec_id as id, greatest(0, least(1, (list_sum(list_transform(range(1, len(e.embedding) + 1), lambda i: cast(e.embedding[i] as double) * cast(q.embedding[i] as double))) + 1) / 2)) as score
  from embeddings e, (select embedding from embeddings where vec_id = 0) q order by score desc, id limit 24
)"""
_RUNS = """o as (
  select o_orderpriority as model, year(o_orderdate) - 1900 as papers, 'c' || (o_custkey % 700) as id, o_orderstatus as predicate, 'c' || (o_orderkey % 900) as object from orders
)"""
_ID = "'matkg:' || regexp_replace({}, '[^A-Za-z0-9-]', '', 'g')"

ORACLE_SQL = {
    "vector_top": f"with {_VECTOR} select id, round(score, 6) as score from hits",
    # RELATED_TO shares L, E, D and _ with the last seven characters of rel:SUPPLIED_BY, LIED_BY.
    "retrieve_ranked": f"""
with {_EDGES}, {_VECTOR}, names as (
  select 'part:' || p_partkey as id, p_name as name, p_type as description, 1 as papers from part
  union all select 'supplier:' || s_suppkey, s_name, '', 0 from supplier
  union all select 'nation:' || n_nationkey, n_name, '', 0 from nation
), damp as (
  select *, case when regexp_matches(name, '(generic|material|property|parameter|technique|process|device)s?$', 'i') then 0.8 else 1.0 end as damp from names
), w as (
  select subject, object, (case when predicate = 'rel:SUPPLIED_BY' then 1.5 + 2 * 4 / 17 else 2.2 end) * coalesce(damp, 1.0) as weight from edges left join damp on object = id
), h1 as (
  select object as id, max(score * weight) as score from hits join w on id = subject group by object
), h2 as (
  select object as id, max(score * weight / 2) as score from h1 join w on id = subject group by object
), graph as (
  select id, arg_max(score, score) as score, arg_min(depth, -score) as depth from (
    select id, score, 0 as depth from hits union all select id, score, 1 from h1 union all select id, score, 2 from h2
  ) group by id
), q as (
  select list_distinct(list_concat([lower(t)], list_filter(regexp_extract_all(lower(t), '[a-z0-9]+'), lambda x: length(x) >= 3))) as ents from (select '{QUESTION}' as t)
), outs as (select subject, count(*) as n from edges group by subject
), scored as (
  select d.id, d.name, coalesce(h.score, 0) * damp as score_sem, g.score * damp as score_graph, depth,
         sqrt(len(list_filter(ents, lambda e: contains(lower(name || ' ' || description), e)))) / len(ents) as lexical_overlap, papers + coalesce(n, 0) as evidence_ct
  from damp d join graph g using (id) left join hits h using (id) left join outs on d.id = subject, q
)
select id, name, round(score_sem, 6) as score_sem, round(score_graph, 6) as score_graph, cast(depth as bigint) as depth, round(lexical_overlap, 6) as lexical_overlap, evidence_ct,
       round(0.8 * score_sem + 0.6 * score_graph / (1 + depth) + 0.6 * lexical_overlap + 0.3 * tanh(evidence_ct / 5), 6) as score_prp
from scored order by 0.8 * score_sem + 0.6 * score_graph / (1 + depth) + 0.6 * lexical_overlap + 0.3 * tanh(evidence_ct / 5) desc, evidence_ct desc, id limit 12
""",
    "context_budget": """
select conv_id, turn, prior, chars from (
  select conv_id, turn, cast(coalesce(sum(length(coalesce(text, ''))) over (partition by conv_id order by turn, role, text rows between unbounded preceding and 1 preceding), 0) as bigint) as prior, length(coalesce(text, '')) as chars from conversations
) where prior < 300
""",
    "graph_degree": f"with {_EDGES} select id, count(*) as degree from (select subject as id from edges union all select object from edges) group by id",
    "graph_strong": f"with {_EDGES}, d as (select id from (select subject as id from edges union all select object from edges) group by id having count(*) >= 2) select * from edges where subject in (select id from d) and object in (select id from d)",
    "graph_k_hop": f"with recursive {_EDGES}, r as (select unnest(['part:1', 'part:2']) as id, 0 as depth union select object, depth + 1 from r join edges on id = subject where depth < 4) select id, min(depth) as depth from r group by id",
    "graph_things": f"""
select id, arg_min(name, k) as name, arg_min(category, k) as category, arg_min(description, k) as description from (
  select {_ID.format("p_name")} as id, p_name as name, p_brand as category, p_type as description, p_partkey * 2 as k from part
  union all select {_ID.format("p_brand")}, p_brand, 'Unknown', '', p_partkey * 2 + 1 from part
) group by id
""",
    "graph_associations": f"select {_ID.format('p_name')} as subject, 'rel:BRANDED' as predicate, {_ID.format('p_brand')} as object, arg_min(p_type, p_partkey) as has_evidence from part group by all",
    "schema_closure": """
with t as (
  select n_name as name, r_name as is_a from nation join region on n_regionkey = r_regionkey union all select r_name, 'Thing' from region union all select 'Thing', null
)
select name, name as ancestor from t union select name, is_a from t where is_a is not null union select a.name, b.is_a from t a join t b on a.is_a = b.name where b.is_a is not null
""",
    "merge_terms": """
with m as (
  select lower(trim(p_type)) as key, p_type as term, p_name as definition, p_brand as category, p_brand as paper, p_size as page, p_partkey as ordinal,
         row_number() over (partition by lower(trim(p_type)), p_size order by p_partkey) as nth from part
), g as (
  select key, arg_min(term, ordinal) as term, arg_min(category, ordinal) as category, arg_max(definition, length(definition) * 100000000 - ordinal) as definition,
         string_agg(page, ',' order by ordinal) filter (where nth = 1) as pages, string_agg(paper, ',' order by ordinal) filter (where nth = 1) as source_papers,
         count(*) filter (where nth = 1) as occ, count(distinct paper) filter (where nth = 1) as papers
  from m group by key
)
select key, term, category, definition, pages, source_papers, case when papers > 1 or occ > 5 then 'high' when occ > 2 then 'medium' else 'low' end as importance from g
""",
    "usable_pages": r"select doc_id from documents where text is not null and len(regexp_split_to_array(trim(text, ' '), '[ \t\n\x0B\f\r]+')) >= 20",
    "term_keys": f"""
select p_partkey, lower(trim(p_name)) as normal, regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g') as canonical, {_ID.format("p_name")} as node_id,
       regexp_matches(p_name, '(generic|material|property|parameter|technique|process|device)s?$', 'i') as generic, array_to_string(regexp_extract_all(lower(p_name), '[a-z0-9]+'), ' ') as tokens from part
""",
    "snippets": r"select doc_id, 1 + len(regexp_extract_all(coalesce(text, ''), '[.?!][ \t\n\x0B\f\r]+')) as n_sentences from documents",
    "mine_properties": """
select p_partkey as page_id, 'mat' as material, 'density' as property, p_size || '.5' as raw_value, 'g/cm3' as raw_unit,
       'The density of mat is ' || p_size || '.5 g/cm3.' as context, true as verified from part
""",
    "normalize_units": """
select p_partkey,
       cast(case p_partkey % 5 when 0 then p_size * 1000.0 when 1 then case when p_size <= 10 then cast(p_size as double) end when 2 then p_size + 273.15 when 3 then case when p_size <= 100 then cast(p_size as double) end else cast(p_size as double) end as double) as normalized_value,
       case p_partkey % 5 when 0 then 'kg/m3' when 1 then case when p_size <= 10 then 'eV' end when 2 then 'K' when 3 then case when p_size <= 100 then '%' end else 'foo' end as normalized_unit,
       cast(case p_partkey % 5 when 0 then 1000.0 when 1 then case when p_size <= 10 then 1.0 end when 3 then case when p_size <= 100 then 1.0 end else 1.0 end as double) as uncertainty_value,
       (p_partkey % 5 = 1 and p_size > 10) or (p_partkey % 5 = 3 and p_size > 100) as unit_conversion_failed
from part
""",
    "graph_structure": f"""
with {_RUNS}, e as (select distinct model, papers, id from o), r as (select distinct model, papers, id as s, predicate, object from o), ends as (select model, papers, s as id from r union select model, papers, object from r)
select model, papers, entities, relations, round(relations / entities, 2) as entity_relation_ratio, round(100 * touched / entities, 1) as entities_with_relations_pct,
       round(2 * relations / entities, 2) as avg_relations_per_entity, unique_predicates, round(entities / papers, 1) as entities_per_paper, round(relations / papers, 1) as relations_per_paper
from (select model, papers, count(*) as entities from e group by all) join (select model, papers, count(*) as relations, count(distinct predicate) as unique_predicates from r group by all) using (model, papers)
join (select model, papers, count(*) as touched from e semi join ends using (model, papers, id) group by all) using (model, papers)
""",
    "graph_growth": f"""
with {_RUNS}, e as (select distinct model, papers, id from o), runs as (select model, papers, lag(papers) over (partition by model order by papers) as earlier from (select distinct model, papers from e)),
c as (
  select r.model, r.papers, r.earlier, count(*) as n_new, count(b.id) as stayed from runs r join e a using (model, papers) left join e b on b.model = r.model and b.papers = r.earlier and b.id = a.id group by all
), n as (select model, papers, count(*) as n from e group by all)
select c.model, c.papers, round(100 * stayed / n.n, 1) as entity_retention, n_new - stayed as new_entities, case when earlier is not null then round((n_new - stayed) / (c.papers - earlier), 2) end as entity_growth_rate
from c left join n on n.model = c.model and n.papers = c.earlier
""",
    "year_votes": "select o_orderkey as doc_id, cast(year(o_orderdate) as int) as year from orders",
    "best_per_node": "select user_id, max(value) as score from events group by user_id",
}

_WHOLE_RUNS = """o as (
  select o_orderpriority as model, year(o_orderdate) - 1900 as papers, 'c' || o_custkey as id, o_orderstatus as predicate, 'c' || o_orderkey as object from orders
)"""
ORACLE_SQL["last_runs"] = f"""
with {_WHOLE_RUNS}, r as (select model, papers, count(distinct id) as entities, count(distinct (id, predicate, object)) as relations from o group by all)
select * from r qualify row_number() over (partition by model order by papers desc) = 1
"""
ORACLE_SQL |= {f"{name}_whole": ORACLE_SQL[name].replace(_RUNS, _WHOLE_RUNS) for name in ("graph_structure", "graph_growth")}
