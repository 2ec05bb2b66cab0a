"""Term mentions merged into one dictionary row a term."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.text import importance, normalize_term
from graphloom.operators.graph import groups
from graphloom.operators.similar import similar
from graphloom.operators.steps import cut


#: What a mention may add to its term's record besides definition, relations and place, and what only mentions with ontology data add later.
OWN, CHEMICAL = ["formula", "formula_validation"], ["chebi", "smiles", "charge", "inchi", "inchikey", "mass"]
#: A long form with its acronym: up to twelve characters without spaces, of which two capitals, in round brackets at the end.
WITH_ACRONYM = r"^\s*(\S.*?)\s*\(\s*((?=[^()\s]{2,12}\s*\))[^()\s]*\p{Lu}[^()\s]*\p{Lu}[^()\s]*)\s*\)\s*\z"


def keyed(mentions: DataFrame) -> DataFrame:
    """Mentions of a name with its ``key``: their own column of that name, else the lower-case term."""
    named = mentions.where(F.trim("term") != "")
    return named if "key" in mentions.columns else named.withColumn("key", normalize_term(F.col("term")))


def concept_key(term: Column) -> Column:
    """A term's letters and digits in lower case, so that only punctuation, spaces and case are ignored; the lower-case term if it has none."""
    bare = F.regexp_replace(F.lower(term), r"[^\p{L}\p{N}]", "")
    return F.when(bare == "", normalize_term(term)).otherwise(bare)


def concepts(mentions: DataFrame) -> DataFrame:
    """``mentions`` (term, ordinal, ...) with ``key``: terms of one concept share it.

    Terms are one concept if they differ in punctuation, spaces and case only,
    or if one is "long form (ACRONYM)" and the other its long form or acronym.
    An acronym that stands with several long forms is left apart from all of
    them. Nothing else is merged, neither similar acronyms nor general and
    special terms. The key is the lower-case term of the concept's first mention.
    """
    named = mentions.where(F.trim("term") != "").withColumn("own_", concept_key(F.col("term")))
    part = lambda g: F.nullif(F.regexp_extract("term", WITH_ACRONYM, g), F.lit(""))
    first = cut(named.groupBy("own_").agg(F.min(F.struct("ordinal", "term")).alias("first")))
    pairs = named.select("own_", concept_key(part(1)).alias("long"), concept_key(part(2)).alias("acronym")).where("long is not null and acronym is not null").distinct()
    pairs = cut(pairs)
    single = pairs.groupBy("acronym").agg(F.min("long").alias("only"), F.count_distinct("long").alias("n")).where("n = 1")
    links = pairs.select(F.col("own_").alias("a"), F.col("long").alias("b")).union(single.select(F.col("acronym").alias("a"), F.col("only").alias("b")))
    of = groups(links)
    known = first.join(of, F.col("own_") == F.col("node"), "left").select("own_", "first", F.coalesce("group", "own_").alias("group"))
    names = known.groupBy("group").agg(F.min("first").alias("least")).select(F.col("group").alias("g"), normalize_term(F.col("least.term")).alias("key"))
    keys = known.join(names, F.col("group") == F.col("g")).select(F.col("own_").alias("own_key_"), "key")
    return named.drop("key").join(keys, F.col("own_") == F.col("own_key_")).drop("own_", "own_key_")


def records(mentions: DataFrame) -> DataFrame:
    """The whole record of each term, from mentions in the order of their ordinals.

    ``mentions`` have term, definition, category, relations, snippet, paper,
    page, ordinal and any columns of OWN and CHEMICAL; a ``key`` of their own is
    kept. The first mention gives the term, category ("Thing" if it has none)
    and its own chemistry; fields that are still empty come from the first later
    mention with ontology data that has them. The longest definition wins, the
    first of them. A page number counts once, with the paper and snippet of its
    first mention. A relation is taken from the first mention that says it.

    Mentions are brought down to one row a page and one a relation of a term
    before anything is listed, so a term that is everywhere is spread over tasks
    until its lists are as short as the record itself.
    """
    rows = keyed(mentions)
    extra = [c for c in OWN + CHEMICAL if c in mentions.columns]
    full = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) != ""
    from_data = full("chebi") if "chebi" in mentions.columns else F.lit(False)
    told = F.col("relations") if "relations" in mentions.columns else F.lit(None).cast("array<struct<relation:string,related_term:string,verified:boolean>>")
    said = F.filter(F.transform(told, lambda r, i: F.struct(i.alias("place"), r["relation"].alias("relation"), r["related_term"].alias("related_term"), r["verified"].alias("verified"))), lambda r: r["relation"].isNotNull())
    # The how-manieth time that a mention says the same.
    again = F.transform(said, lambda r: r.withField("again", F.size(F.filter(said, lambda q: (q["place"] <= r["place"]) & (q["relation"] == r["relation"]) & q["related_term"].eqNullSafe(r["related_term"])))))
    snippet = F.col("snippet") if "snippet" in mentions.columns else F.lit(None).cast("string")
    none = F.lit(None).cast("struct<place:int,relation:string,related_term:string,verified:boolean,again:int>")
    base = rows.select("key", "ordinal", "page", "paper", snippet.alias("snippet"), "term", "category", F.coalesce("definition", F.lit("")).alias("definition"), *extra, from_data.alias("data_"), F.explode(F.concat(F.array(none), F.coalesce(again, F.array().cast("array<struct<place:int,relation:string,related_term:string,verified:boolean,again:int>>")))).alias("r"))
    own = F.struct("ordinal", "term", "category", *extra)
    best = F.struct(F.length("definition").alias("n"), (-F.col("ordinal")).alias("back"), "definition")
    later = {c: F.when(F.col("data_") & full(c), F.struct(F.col("ordinal"), F.col(c).alias("value"))) for c in extra}
    page = F.when(F.col("r").isNull(), F.col("page"))
    facet = base.groupBy("key", F.col("r").isNull().alias("is_page"), page.alias("page"), "r.relation", "r.related_term", "r.again").agg(
        F.min_by(own, "ordinal").alias("first"),
        F.max(best).alias("longest"),
        F.min_by(F.struct("ordinal", F.col("page").alias("page"), "paper", "snippet"), "ordinal").alias("spot"),
        F.min_by(F.struct("ordinal", "r.place", "r.relation", "r.related_term", "r.verified", "r.again"), "ordinal").alias("said"),
        *(F.min_by(later[c], later[c]["ordinal"]).alias(f"later_{c}") for c in extra),
    )
    made = facet.groupBy("key").agg(
        F.min_by("first", "first.ordinal").alias("first"),
        F.max("longest").alias("longest"),
        F.array_sort(F.collect_list(F.when(F.col("is_page"), F.col("spot")))).alias("spots"),
        F.array_sort(F.collect_list(F.when(~F.col("is_page"), F.col("said")))).alias("said"),
        *(F.min_by(f"later_{c}", f"later_{c}.ordinal").alias(f"later_{c}") for c in extra),
    )
    kept = F.filter("said", lambda r: (r["again"] == 1) | F.exists("said", lambda q: (q["again"] == 1) & (q["ordinal"] == r["ordinal"]) & (q["relation"] == r["relation"]) & q["related_term"].eqNullSafe(r["related_term"])))
    first_or_later = lambda c: F.when(F.coalesce(F.col(f"first.{c}").cast("string"), F.lit("")) != "", F.col(f"first.{c}")).otherwise(F.col(f"later_{c}.value"))
    return made.select(
        "key",
        F.col("first.term").alias("term"),
        F.col("longest.definition").alias("definition"),
        F.coalesce("first.category", F.lit("Thing")).alias("category"),
        *(first_or_later(c).alias(c) for c in extra),
        F.transform(kept, lambda r: F.struct(r["relation"].alias("relation"), r["related_term"].alias("related_term"), r["verified"].alias("verified"))).alias("relations"),
        F.col("spots.page").alias("pages"),
        F.col("spots.paper").alias("source_papers"),
        F.transform("spots", lambda s: F.struct(s["snippet"].alias("text"), s["paper"].alias("source_paper"), s["page"].alias("page"))).alias("context_snippets"),
        importance(F.size("spots"), F.size(F.array_distinct(F.col("spots.paper")))).alias("importance"),
        F.col("first.ordinal").alias("ordinal"),
    )


def as_mentions(known: DataFrame) -> DataFrame:
    """Records as the mentions that give them again, before any with an ordinal from 0 on: a mention a page, of which the first has all else.

    So a dictionary that was saved without its mentions can be continued: these
    rows and new mentions together merge as if the old ones were still there.
    ``known`` are records with a key each; those without a page have one mention.
    """
    extra = [c for c in OWN + CHEMICAL if c in known.columns]
    named = known if "key" in known.columns else known.withColumn("key", normalize_term(F.col("term")))
    one = F.struct(F.lit(None).cast("int").alias("page"), F.lit(None).cast("string").alias("paper"), F.lit(None).cast("string").alias("snippet"))
    spots = F.transform(F.arrays_zip("pages", "source_papers", F.col("context_snippets.text").alias("said")), lambda s: F.struct(s["pages"].cast("int").alias("page"), s["source_papers"].alias("paper"), s["said"].alias("snippet")))
    each = named.select("key", "term", "definition", "category", "relations", *extra, F.posexplode(F.when(F.size(spots) > 0, spots).otherwise(F.array(one))).alias("n", "spot"))
    first = F.col("n") == 0
    # Ordinals only order the mentions of one key, and tell all mentions apart.
    ordinal = F.lit(-(1 << 62)) + F.pmod(F.xxhash64("key"), F.lit(1 << 41)) * (1 << 20) + F.col("n")
    return each.select("key", "term", F.when(first, F.col("definition")).alias("definition"), "category", F.when(first, F.col("relations")).alias("relations"), *(F.when(first, F.col(c)).alias(c) for c in extra), "spot.page", "spot.paper", "spot.snippet", ordinal.alias("ordinal"))


def with_properties(terms: DataFrame, attached: DataFrame) -> DataFrame:
    """Records with the list ``properties`` of ``attached_properties``; an empty one where a term has none."""
    kind = "array<struct<property:string,value:double,unit:string,uncertainty:double,context:string,verified:boolean>>"
    row = F.struct("property", F.col("value").cast("double").alias("value"), "unit", F.col("uncertainty").cast("double").alias("uncertainty"), "context", "verified")
    listed = attached.groupBy(F.col("key").alias("of_")).agg(F.array_sort(F.collect_list(row)).alias("properties"))
    return terms.join(listed, F.col("key") == F.col("of_"), "left").drop("of_").withColumn("properties", F.coalesce("properties", F.array().cast(kind)))


def usable_pages(pages: DataFrame, least: int = 20) -> DataFrame:
    """Pages with enough words; a projection over the scan, no shuffle."""
    return pages.where(F.size(F.split(F.trim("text"), r"\s+")) >= least)


def merge_mentions(mentions: DataFrame) -> DataFrame:
    """One row a key from mentions (term, definition, category, paper, page, ordinal).

    The first mention gives name and category, the longest definition wins
    (ties: the first), and a page number counts once, with the paper of its
    first mention.
    """
    firsts = keyed(mentions).groupBy("key", "page").agg(
        F.min_by(F.struct("ordinal", "page", "paper"), "ordinal").alias("spot"),
        F.min(F.struct("ordinal", "term", "category")).alias("first"),
        F.max(F.struct(F.length("definition").alias("n"), (-F.col("ordinal")).alias("back"), "definition")).alias("longest"),
    )
    merged = firsts.groupBy("key").agg(F.array_sort(F.collect_list("spot")).alias("spots"), F.min("first").alias("first"), F.max("longest").alias("longest"))
    occurrences, papers = F.size("spots"), F.size(F.array_distinct(F.col("spots.paper")))
    return merged.select(
        "key",
        F.col("first.term").alias("term"),
        F.col("first.category").alias("category"),
        F.col("longest.definition").alias("definition"),
        F.col("spots.page").alias("pages"),
        F.col("spots.paper").alias("source_papers"),
        importance(occurrences, papers).alias("importance"),
    )


def filled_content(mentions: DataFrame, columns: list[str]) -> DataFrame:
    """(key, columns): per term the first value that isn't empty, among its first mention's and those of mentions with ontology data (``chebi``)."""
    named = keyed(mentions)
    first = named.groupBy(F.col("key").alias("k")).agg(F.min("ordinal").alias("first_ordinal"))
    rows = named.join(first, F.col("key") == F.col("k")).where((F.col("ordinal") == F.col("first_ordinal")) | (F.coalesce("chebi", F.lit("")) != ""))
    return rows.groupBy("key").agg(*(F.min_by(F.when(F.coalesce(c, F.lit("")) != "", F.col(c)), F.when(F.coalesce(c, F.lit("")) != "", F.col("ordinal"))).alias(c) for c in columns))


def merged_relations(mentions: DataFrame) -> DataFrame:
    """(key, relation, related_term, verified): each relation of a term once, as first said, from mentions with an array ``relations``."""
    each = mentions.where(F.trim("term") != "").select(normalize_term(F.col("term")).alias("key"), "ordinal", F.posexplode("relations").alias("place", "r"))
    return each.groupBy("key", "r.relation", "r.related_term").agg(F.min_by("r.verified", F.struct("ordinal", "place")).alias("verified"))


def attached_properties(terms: DataFrame, found: DataFrame) -> DataFrame:
    """(key, property, value, unit, uncertainty, context, verified): normalised properties of known materials, each (property, value, unit, context) once."""
    known = terms.select("key").distinct()
    rows = found.withColumn("key", normalize_term(F.col("material"))).join(known, "key", "left_semi")
    same = ["key", "property", F.col("normalized_value").alias("value"), F.col("normalized_unit").alias("unit"), "context"]
    return rows.groupBy(*same).agg(F.min_by(F.struct(F.col("uncertainty_value").alias("u"), (~F.col("unit_conversion_failed")).alias("ok")), "ordinal").alias("f")).select(
        "key", "property", "value", "unit", F.col("f.u").alias("uncertainty"), "context", F.col("f.ok").alias("verified")
    )


def older_merge(mentions: DataFrame) -> DataFrame:
    """(key, pages, source_papers, total_occurrences, paper_count): pages and papers without repeats, each on their own; pages in order, papers as first seen."""
    named = keyed(mentions)
    pages = named.groupBy("key").agg(F.array_sort(F.collect_set("page")).alias("pages"), F.count("*").alias("total_occurrences"))
    seen = named.groupBy("key", "paper").agg(F.min("ordinal").alias("at")).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("at", "paper"))).alias("seen"))
    return pages.join(seen, "key").select("key", "pages", F.col("seen.paper").alias("source_papers"), "total_occurrences", F.size("seen").cast("long").alias("paper_count"))


def run_counters(pages: DataFrame, mentions: DataFrame) -> DataFrame:
    """One row: files, pages, pages with terms and different terms."""
    read = pages.agg(F.countDistinct("paper").alias("files"), F.count("*").alias("pages"))
    named = mentions.where(F.trim("term") != "")
    found = named.agg(F.countDistinct("paper", "page").alias("pages_with_terms"), F.countDistinct(normalize_term(F.col("term"))).alias("unique_terms"))
    return read.join(found)


def first_like(mentions: DataFrame, known: DataFrame, least: float = 0.85) -> DataFrame:
    """(term, match): the first known name (name, ordinal) whose matching blocks cover more than ``least`` of both; every such name is found, whatever its first letter."""
    asked = mentions.select(normalize_term(F.col("term")).alias("term"))
    names = known.select(normalize_term(F.col("name")).alias("name"), "ordinal").groupBy("name").agg(F.min("ordinal").alias("ordinal"))
    found = similar(asked, names.select("name"), least, "sequence", strict=True)
    return found.join(names, F.col("right") == F.col("name")).groupBy(F.col("left").alias("term")).agg(F.min_by("name", "ordinal").alias("match"))
