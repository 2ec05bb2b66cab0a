"""Triples of Turtle files, a file a task: prefixes count for the rest of their file, so a file can't be split. Large graphs belong in N-Triples.

IRIs, prefixed names, literals of all four quotes, numbers, booleans, lists of
objects and predicates, nested blank nodes and collections are read. A broken
statement gives a row with its line and the fault, and reading goes on after
the next full stop at the end of a line.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
TOKEN = re.compile(
    r'''(?P<skip>(?:\s+|\#[^\n]*)+)
    |(?P<iri><[^<>"{}|^`\\\x00-\x20]*>)
    |(?P<text>"""(?:[^"\\]|\\.|"(?!""))*+"""|\'\'\'(?:[^'\\]|\\.|'(?!''))*+\'\'\'|"(?:[^"\\\n]|\\.)*+"|'(?:[^'\\\n]|\\.)*+')
    |(?P<lang>@[a-zA-Z]+(?:-[a-zA-Z0-9]+)*)
    |(?P<type>\^\^)
    |(?P<blank>_:[\w](?:[\w.\-]*[\w\-])?)
    |(?P<number>[+-]?(?:\d+\.\d*[eE][+-]?\d+|\.?\d+[eE][+-]?\d+|\d*\.\d+|\d+))
    |(?P<name>(?:[A-Za-z\u00C0-\uFFFD](?:[\w.\-]*[\w\-])?)?:(?:(?:[\w:%]|\\.)(?:(?:[\w.\-:%]|\\.)*(?:[\w\-:%]|\\.))?)?)
    |(?P<word>[A-Za-z]+)
    |(?P<mark>[.;,\[\]()])''',
    re.VERBOSE | re.DOTALL,
)
ESCAPE = re.compile(r"\\(u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|.)", re.DOTALL)
PLAIN = {"t": "\t", "b": "\b", "n": "\n", "r": "\r", "f": "\f"}
STOP = re.compile(r"\.[ \t]*(?:\#[^\n]*)?(?:\n|\Z)")


def unescaped(text: str) -> str:
    return ESCAPE.sub(lambda m: chr(int(m[1][1:], 16)) if m[1][0] in "uU" and len(m[1]) > 1 else PLAIN.get(m[1], m[1]), text)


class Document:
    """Reads one text; ``rows`` are (s, p, o, line, error)."""

    def __init__(self, text: str, scope: str):
        self.text, self.scope, self.at, self.last, self.blanks = text, scope, 0, 0, 0
        self.prefixes: dict[str, str] = {}
        self.base = ""
        self.rows: list[tuple] = []
        self.found: list[tuple[str, str, str]] = []

    def read(self) -> list[tuple]:
        while True:
            start = self.at
            try:
                kind, _ = self.peek()
                if kind == "end":
                    return self.rows
                start = self.at
                self.found = []
                self.statement()
                self.rows += [(*t, None, None) for t in self.found]
            except (ValueError, KeyError, RecursionError) as fault:
                line = self.text.count("\n", 0, start) + 1
                self.rows.append((None, None, None, line, str(fault)))
                # The token that was not expected may be the full stop itself.
                stop = STOP.search(self.text, max(self.last, start))
                self.at = stop.end() if stop else len(self.text)

    def peek(self) -> tuple[str, str]:
        while self.at < len(self.text):
            found = TOKEN.match(self.text, self.at)
            if not found:
                raise ValueError(f"not understood: {self.text[self.at : self.at + 20]!r}")
            if found.lastgroup != "skip":
                return found.lastgroup, found[0]
            self.at = found.end()
        return "end", ""

    def take(self, wanted: str = "") -> tuple[str, str]:
        kind, value = self.peek()
        if wanted and value != wanted:
            raise ValueError(f"{wanted} expected, not {value or 'the end'}")
        self.last = self.at
        self.at += len(value)
        return kind, value

    def iri(self, value: str) -> str:
        named = unescaped(value[1:-1])
        return named if re.match(r"[A-Za-z][A-Za-z0-9+.\-]*:", named) else self.base + named

    def named(self, value: str) -> str:
        prefix, _, local = value.partition(":")
        if prefix not in self.prefixes:
            raise ValueError(f"no prefix {prefix}:")
        return self.prefixes[prefix] + re.sub(r"\\(.)", r"\1", local)

    def fresh(self) -> str:
        self.blanks += 1
        return f"_:{self.scope}_{self.blanks}"

    def statement(self) -> None:
        kind, value = self.peek()
        low = value.lower()
        if (kind == "lang" and low in ("@prefix", "@base")) or (kind == "word" and low in ("prefix", "base")):
            self.take()
            if low.endswith("prefix"):
                _, prefix = self.take()
                if not prefix.endswith(":"):
                    raise ValueError(f"{prefix} is no prefix")
                self.prefixes[prefix[:-1]] = self.reference()
            else:
                self.base = self.reference()
            if kind == "lang":
                self.take(".")
            return
        subject = self.node()
        if self.peek()[1] != "." or value != "[":
            self.predicates(subject)
        self.take(".")

    def reference(self) -> str:
        kind, value = self.take()
        if kind != "iri":
            raise ValueError(f"an IRI expected, not {value}")
        return self.iri(value)

    def predicates(self, subject: str) -> None:
        while True:
            kind, value = self.take()
            if kind == "word" and value == "a":
                predicate = f"{RDF}type"
            elif kind == "iri":
                predicate = self.iri(value)
            elif kind == "name":
                predicate = self.named(value)
            else:
                raise ValueError(f"a predicate expected, not {value or 'the end'}")
            while True:
                self.found.append((subject, predicate, self.node(literal=True)))
                if self.peek()[1] != ",":
                    break
                self.take()
            more = False
            while self.peek()[1] == ";":
                self.take()
                more = True
            if not more or self.peek()[1] in (".", "]"):
                return

    def node(self, literal: bool = False) -> str:
        kind, value = self.take()
        if kind == "iri":
            return self.iri(value)
        if kind == "name":
            return self.named(value)
        if kind == "blank":
            return value
        if value == "[":
            made = self.fresh()
            if self.peek()[1] != "]":
                self.predicates(made)
            self.take("]")
            return made
        if value == "(":
            items = []
            while self.peek()[1] != ")":
                items.append(self.node(literal=True))
            self.take(")")
            nodes = [self.fresh() for _ in items]
            for i, (at, item) in enumerate(zip(nodes, items, strict=True)):
                self.found += [(at, f"{RDF}first", item), (at, f"{RDF}rest", nodes[i + 1] if i + 1 < len(nodes) else f"{RDF}nil")]
            return nodes[0] if nodes else f"{RDF}nil"
        if literal and kind == "text":
            size = 3 if value[:3] in ('"""', "'''") and len(value) >= 6 else 1
            if self.peek()[0] == "lang":
                self.take()
            elif self.peek()[0] == "type":
                self.take()
                if self.take()[0] not in ("iri", "name"):
                    raise ValueError("a type expected")
            return unescaped(value[size:-size])
        if literal and (kind == "number" or value in ("true", "false")):
            return value
        raise ValueError(f"{'an object' if literal else 'a subject'} expected, not {value or 'the end'}")


def read_turtle(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(triples with s, p and o, faults with path, line and error). Literals come without quotes, language and type, as from N-Triples.

    Blank nodes without a name get one from a digest of their file's path, so
    those of different files differ and a second run gives the same.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at, content in zip(batch["path"], batch["content"], strict=True):
                scope = hashlib.sha1(at.encode()).hexdigest()[:8]
                rows = [(at, *r) for r in Document(bytes(content).decode("utf-8", "replace").lstrip("\ufeff"), scope).read()]
                yield pd.DataFrame(rows, columns=["path", "s", "p", "o", "line", "error"]).astype({"line": "Int32"})

    rows = files.mapInPandas(run, "path string, s string, p string, o string, line int, error string")
    return rows.where("error is null").select("s", "p", "o"), rows.where("error is not null").select("path", "line", "error")
