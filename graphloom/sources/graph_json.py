"""Terms and graph documents in JSON, term tables in OBO text, gap logs in JSON lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The chemical properties of an ontology's entries.
PROPERTIES = ["formula", "mass", "charge", "inchi", "inchikey", "smiles"]
TERM = (
    "struct<term string, definition string, category string, formula string, "
    "relations array<struct<relation string, related_term string, verified boolean>>, pages array<int>, "
    "source_papers array<string>, context_snippets array<struct<text string, source_paper string, page int>>, "
    "properties array<struct<property string, value double, unit string, uncertainty double, context string, verified boolean>>, "
    "formula_validation struct<input string, canonical string, mp_hits int, status string, error string>, chebi string, smiles string, charge string, inchi string, inchikey string, mass string, "
    "importance string>"
)
GRAPH = "struct<things array<struct<id string, name string, category string, description string, pages array<int>, source_papers array<string>>>, associations array<struct<subject string, predicate string, object string, has_evidence string>>>"


def read_terms(spark: SparkSession, path: str) -> DataFrame:
    """Terms of documents that wrap them in ``terms`` or are a bare list."""
    text = spark.read.text(path, wholetext=True)
    bare = F.trim("value").startswith("[")
    terms = F.when(bare, F.from_json("value", f"array<{TERM}>")).otherwise(F.from_json("value", f"struct<terms array<{TERM}>>")["terms"])
    return text.select(F.inline(terms))


def read_term_names(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(names with path and term, faults with path): the terms' names of each document, and the documents that are no object with a list of terms."""
    text = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.from_json("value", "struct<terms array<struct<term string>>>")["terms"].alias("terms"))
    return text.select("path", F.explode("terms.term").alias("term")).where("term is not null"), text.where("terms is null").select("path")


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(things with an id, associations with subject, predicate and object)."""
    graph = spark.read.text(path, wholetext=True).select(F.from_json("value", GRAPH).alias("g"))
    things = graph.select(F.inline("g.things")).where("coalesce(id, '') <> ''")
    edges = graph.select(F.inline("g.associations"))
    return things, edges.where("coalesce(subject, '') <> '' and coalesce(predicate, '') <> '' and coalesce(object, '') <> ''")


def write_graph(things: DataFrame, edges: DataFrame, path: str) -> None:
    """Parquet, one folder a table: the form that scales."""
    things.write.mode("overwrite").parquet(f"{path}/things")
    edges.write.mode("overwrite").parquet(f"{path}/associations")


def read_obo(spark: SparkSession, path: str) -> DataFrame:
    """(id, name, definition, synonyms, parents, roles, relationships, xrefs, and the chemical values of PROPERTIES) of each [Term] stanza.

    A chemical value is the second word of the last property_value whose IRI ends
    in ``/chebi/`` and its name, without quotes and type; what follows a space in
    a value is lost. Of a value such as "1"^^xsd:string the quotes go on both sides.
    """
    stanza = spark.read.option("lineSep", "\n\n").text(path).where(F.contains("value", F.lit("[Term]")))

    def one(tag: str):
        return F.nullif(F.regexp_extract("value", rf"(?m)^{tag}: (.*)$", 1), F.lit(""))

    def every(pattern: str):
        return F.regexp_extract_all("value", F.lit(rf"(?m)^{pattern}"), F.lit(1))

    return stanza.select(
        one("id").alias("id"),
        one("name").alias("name"),
        F.nullif(F.regexp_extract("value", '(?m)^def: "([^"]*)"', 1), F.lit("")).alias("definition"),
        every('synonym: "([^"]*)"').alias("synonyms"),
        every(r"is_a: (\S+)").alias("parents"),
        every(r"relationship: has_role (\S+)").alias("roles"),
        F.transform(every(r"relationship: (\S+ \S+)"), lambda r: F.struct(F.substring_index(r, " ", 1).alias("predicate"), F.substring_index(r, " ", -1).alias("target"))).alias("relationships"),
        every(r"xref: (\S+)").alias("xrefs"),
        *(property_value(F.col("value"), name).alias(name) for name in PROPERTIES),
    )


def property_value(stanza: Column, name: str) -> Column:
    """The last value of a chemical property in a stanza, or null."""
    words = F.regexp_extract_all(stanza, F.lit(rf"(?m)^property_value: \S*/chebi/{name}[ \t]+(\S+)"), F.lit(1))
    last = F.try_element_at(words, F.lit(-1))
    return F.regexp_replace(F.regexp_replace(last, r'\^\^\S*$', ""), r'^"+|"+$', "")


def append_gaps(gaps: DataFrame, path: str) -> None:
    """Knowledge gaps (query, entity, reason), stamped and appended as JSON lines."""
    gaps.withColumn("timestamp", F.unix_micros(F.current_timestamp()) / 1e6).write.mode("append").json(path)


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).where(F.trim("value") != "").select(F.trim("value").alias("question"))


def read_triples(spark: SparkSession, path: str) -> DataFrame:
    """(s, p, o) of N-Triples lines; literals without quotes, language and type."""
    line = spark.read.text(path).where(F.trim("value").rlike(r"^[<_].*\.$"))
    part = lambda g: F.regexp_extract("value", r'^\s*(<[^>]*>|_:\S+)\s+(<[^>]*>)\s+(<[^>]*>|_:\S+|"(?:[^"\\]++|\\.)*+")', g)
    bare = lambda x: F.regexp_replace(F.regexp_replace(x, r'^[<"]|[>"]$', ""), r'\\(["\\])', "$1")
    return line.select(bare(part(1)).alias("s"), bare(part(2)).alias("p"), bare(part(3)).alias("o"))


def write_triples(triples: DataFrame, path: str) -> None:
    """N-Triples; objects that are no IRIs are written as literals."""
    iri = lambda c: F.when(c.startswith("_:"), c).otherwise(F.concat(F.lit("<"), c, F.lit(">")))
    quoted = F.concat(F.lit('"'), F.replace(F.replace(F.col("o"), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    obj = F.when(F.col("o").rlike(r"^(https?://|urn:|_:)\S+$"), iri(F.col("o"))).otherwise(quoted)
    triples.select(F.concat_ws(" ", iri(F.col("s")), iri(F.col("p")), obj, F.lit(".")).alias("value")).write.mode("overwrite").text(path)


def read_papers(spark: SparkSession, folder: str) -> DataFrame:
    """(paper, path, length) of the PDF files of a folder, whatever the case of their suffix; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.where(F.lower("path").endswith(".pdf")).select(F.substring_index("path", "/", -1).alias("paper"), "path", "length")


def whole_texts(pages: DataFrame) -> DataFrame:
    """(paper, text): each paper's pages (paper, page, text) in order, joined by newlines."""
    parts = pages.groupBy("paper").agg(F.array_sort(F.collect_list(F.struct("page", "text"))).alias("parts"))
    return parts.select("paper", F.array_join(F.transform("parts", lambda p: F.coalesce(p["text"], F.lit(""))), "\n").alias("text"))


def write_terms(terms: DataFrame, path: str) -> None:
    """Parquet, with empty lists of properties where there are none."""
    kind = dict(terms.dtypes).get("properties", "array<string>")
    filled = F.coalesce(F.col("properties") if "properties" in terms.columns else F.lit(None), F.array().cast(kind))
    terms.withColumn("properties", filled).write.mode("overwrite").parquet(path)


#: Records of one JSON document that is written.
PER_DOCUMENT = 1000


def _documents(rows: DataFrame, field: str, total: int, per_file: int) -> DataFrame:
    """(part, field) lists of about ``per_file`` rows each, dealt by their hashes."""
    part = F.pmod(F.xxhash64(*(F.col(c).cast("string") for c in rows.columns[:3])), F.lit(max(1, -(-total // per_file)))).alias("part")
    return rows.select(part, F.struct(*rows.columns).alias("row")).groupBy("part").agg(F.array_sort(F.collect_list(F.to_json("row"))).alias(field))


def export_terms(terms: DataFrame, path: str, per_file: int = PER_DOCUMENT) -> None:
    """JSON documents ``{"terms": [...]}``, a file each, of about ``per_file`` records, as ``read_terms`` takes them; a record without properties has an empty list of them."""
    kind = dict(terms.dtypes).get("properties", "array<string>")
    filled = F.coalesce(F.col("properties") if "properties" in terms.columns else F.lit(None), F.array().cast(kind))
    rows = terms.withColumn("properties", filled)
    made = _documents(rows.select("term", *(c for c in rows.columns if c != "term")), "terms", rows.count(), per_file)
    made.select(F.concat(F.lit('{"terms": ['), F.array_join("terms", ",\n"), F.lit("]}")).alias("value")).write.mode("overwrite").option("maxRecordsPerFile", 1).text(path)


def export_graph(things: DataFrame, edges: DataFrame, path: str, per_file: int = PER_DOCUMENT) -> None:
    """JSON documents ``{"things": [...], "associations": [...]}``, a file each, as ``read_graph`` takes them."""
    total = max(things.count(), edges.count())
    nodes, links = _documents(things, "things", total, per_file), _documents(edges, "associations", total, per_file).withColumnRenamed("part", "of")
    both = nodes.join(links, F.col("part") == F.col("of"), "full_outer")
    listed = lambda c: F.concat(F.lit(f'"{c}": ['), F.coalesce(F.array_join(c, ",\n"), F.lit("")), F.lit("]"))
    both.select(F.concat(F.lit("{"), listed("things"), F.lit(", "), listed("associations"), F.lit("}")).alias("value")).write.mode("overwrite").option("maxRecordsPerFile", 1).text(path)


#: Classes and slots of a schema that is written as one document.
MOST_IN_SCHEMA = 100_000


def write_schema(classes: DataFrame, slots: DataFrame, path: str) -> None:
    """A schema as one JSON document, which is YAML as well: classes and slots by name, as ``read_schema`` takes them. Schemas are small; larger ones are refused."""
    import json

    if classes.count() + slots.count() > MOST_IN_SCHEMA:
        raise ValueError("too many classes and slots for one document")
    order = lambda t: t.orderBy(*(["pos"] if "pos" in t.columns else []), "name").drop("pos")
    named = lambda t: {r.name: {k: v for k, v in r.asDict().items() if k != "name" and v is not None} for r in order(t).collect()}
    text = json.dumps({"classes": named(classes), "slots": named(slots)}, indent=2, ensure_ascii=False)
    classes.sparkSession.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def write_table(rows: DataFrame, path: str) -> None:
    """CSV files with a header, as for metrics and for years of papers."""
    rows.write.mode("overwrite").option("header", "true").csv(path)


def write_grouped(rows: DataFrame, key: str, path: str) -> None:
    """JSON lines, one a key with its rows in a list."""
    rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*(c for c in rows.columns if c != key)))).alias("rows")).write.mode("overwrite").json(path)


def append_answers(answers: DataFrame, path: str) -> None:
    """A batch of answers to questions, appended as JSON lines."""
    answers.write.mode("append").json(path)


def read_schema(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(classes, slots) of a LinkML schema in YAML: (name, description, is_a, pos) and (name, description, is_a, domain, range, pos)."""
    import yaml

    text = "\n".join(r.value for r in spark.read.text(path, wholetext=True).collect())
    given = yaml.safe_load(text) or {}

    def made(kind: str, fields: list[str]) -> DataFrame:
        rows = [(n, *((d or {}).get(f) for f in fields), i) for i, (n, d) in enumerate((given.get(kind) or {}).items())]
        return spark.createDataFrame(rows, f"name string, {', '.join(f'{f} string' for f in fields)}, pos int")

    return made("classes", ["description", "is_a"]), made("slots", ["description", "is_a", "domain", "range"])
