"""String functions on terms, names, sentences and predicates, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from graphloom.functions.expressions import let

#: Fixed value: names that say little.
GENERIC = r"(?i)(generic|material|property|parameter|technique|process|device)s?$"


def normalize_term(x: Column) -> Column:
    return F.lower(F.regexp_replace(x, r"^\s+|\s+$", ""))


def canonical_key(x: Column) -> Column:
    return F.regexp_replace(F.lower(x), "[^a-z0-9]", "")


def make_id(x: Column) -> Column:
    return F.concat(F.lit("matkg:"), F.regexp_replace(x, r"[^A-Za-z0-9\-]", ""))


def tokens(x: Column) -> Column:
    return F.regexp_extract_all(F.lower(x), F.lit("[a-z0-9]+"), F.lit(0))


def sentences(x: Column) -> Column:
    return F.split(x, r"(?<=[.?!])\s+")


def snippet(page: Column, term: Column, words: int = 50) -> Column:
    """First words of the first sentence that holds the term, else of the page.

    The term is computed once a row, not once a sentence, so the time grows with
    the length of the page whatever expression the term is.
    """
    found = let(F.lower(term), lambda t: F.get(F.filter(sentences(page), lambda s: F.contains(F.lower(s), t)), F.lit(0)))
    return F.array_join(F.slice(F.split(F.trim(F.coalesce(found, page)), r"\s+"), 1, words), " ")


def local_name(predicate: Column) -> Column:
    return F.substring_index(predicate, ":", -1)


def is_generic(name: Column) -> Column:
    return name.rlike(GENERIC)


def sub_questions(question: Column) -> Column:
    parts = F.filter(F.transform(F.split(question, "[?;,]"), lambda p: F.trim(p)), lambda p: F.length(p) >= 3)
    return F.when(F.size(parts) > 0, parts).otherwise(F.array(question))


def query_entities(question: Column) -> Column:
    """The question and its tokens of three characters or more, lower-cased, without repeats, in order."""
    words = F.filter(tokens(question), lambda w: F.length(w) >= 3)
    return F.array_distinct(F.concat(F.array(F.lower(question)), words))


def knowledge_gaps(reply: Column) -> Column:
    found = F.transform(F.regexp_extract_all(reply, F.lit(r"\[Domain Knowledge\](.*?)\n"), F.lit(1)), lambda e: F.trim(e))
    return F.transform(found, lambda e: F.when(e == "", "unspecified").otherwise(e))


def importance(occurrences: Column, papers: Column) -> Column:
    return F.when((papers > 1) | (occurrences > 5), "high").when(occurrences > 2, "medium").otherwise("low")


def hinted_snippet(text: Column, length: int, hints: list[str]) -> Column:
    """``length`` characters, from a quarter of them before the first hint; from the start without a hit; all of a short text."""
    found = [F.nullif(F.instr(F.lower(text), h.lower()), F.lit(0)) for h in hints]
    first = F.array_min(F.array_compact(F.array(*found))) if found else F.lit(None).cast("int")
    start = F.when(first.isNull(), 1).otherwise(F.greatest(first - length // 4, F.lit(1)))
    return F.when(F.length(text) <= length, text).otherwise(F.substring(text, start, F.lit(length)))


def without_escapes(x: Column) -> Column:
    """Without the terminal's colour and cursor sequences."""
    return F.regexp_replace(x, r"\x1B\[[0-?]*[ -/]*[@-~]", "")


def terms_object(reply: Column) -> Column:
    """The longest JSON object in a reply, nested up to three levels, that parses and has ``terms``; as text.

    Runs and groups are possessive: what they take never has to be given back,
    and Java's matcher then loops where it would recurse once a character.
    """
    flat = r"\{[^{}]*+\}"
    two = rf"\{{(?:[^{{}}]++|{flat})*+\}}"
    three = rf"\{{(?:[^{{}}]++|{two})*+\}}"
    found = F.regexp_extract_all(reply, F.lit(f"({three})"), F.lit(1))
    ordered = F.array_sort(found, lambda a, b: F.length(b) - F.length(a))
    return F.get(F.filter(ordered, lambda x: F.get_json_object(x, "$.terms").isNotNull()), F.lit(0))


def looks_like_formula(x: Column) -> Column:
    return x.rlike(r"[A-Z][a-z]?\d")


def digest_id(x: Column) -> Column:
    return F.left(F.sha1(x.cast("binary")), F.lit(16))


def file_safe(x: Column) -> Column:
    return F.translate(x, "/: ", "___")


def triple_text(subject: Column, predicate: Column, target: Column) -> Column:
    return F.concat(F.lit("("), subject, F.lit(") -["), local_name(predicate), F.lit("]-> ("), target, F.lit(")"))


def named_in(question: Column, name: Column) -> Column:
    """Whether the name stands in the question as a phrase between spaces."""
    pad = lambda x: F.concat(F.lit(" "), F.lower(x), F.lit(" "))
    return F.contains(pad(question), pad(name))


def embedding_text(name: Column, description: Column) -> Column:
    return F.left(F.trim(F.concat_ws(" ", name, description)), F.lit(1024))


def class_id(label: Column) -> Column:
    """A label as an identifier: others than letters, digits and underscores become underscores; X goes before one that starts with no letter."""
    safe = F.regexp_replace(label, r"[^\p{L}\p{N}_]", "_")
    return F.when(safe.rlike(r"^\p{L}"), safe).otherwise(F.concat(F.lit("X"), safe))


def scheme_id(label: Column) -> Column:
    """A label in title case without spaces; a letter is a capital unless another letter is before it."""
    words = F.regexp_extract_all(label, F.lit(r"\p{L}+|[^\p{L}]+"), F.lit(0))
    titled = F.transform(words, lambda w: F.concat(F.upper(F.left(w, F.lit(1))), F.lower(F.substring(w, F.lit(2), F.length(w)))))
    return F.replace(F.array_join(titled, ""), F.lit(" "), F.lit(""))


def label_or_tail(label: Column, node: Column) -> Column:
    return F.coalesce(label, F.substring_index(node, "/", -1))


def cross_reference(x: Column) -> Column:
    """(db, ref) of a reference, parted at its first colon; nulls without one."""
    part = lambda g: F.nullif(F.regexp_extract(x, "^([^:]*):(.*)$", g), F.lit(""))
    return F.struct(part(1).alias("db"), part(2).alias("ref"))


def extraction_prompt(schema: Column, page: Column, tail: int = 8000) -> Column:
    """A request to extract terms, with the schema's text and the end of a page."""
    return F.concat(F.lit("Extract the scientific terms of the text as JSON.\n\nSchema:\n"), schema, F.lit("\n\nText:\n"), F.right(page, F.lit(tail)))


def answer_prompt(question: Column, context: Column) -> Column:
    return F.concat(F.lit("Answer from the context; mark other knowledge as [Domain Knowledge].\n\nContext:\n"), context, F.lit("\n\nQuestion: "), question)
