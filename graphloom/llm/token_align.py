"""Groups of tokens of two tokenizers that cover the same bytes, and how often ids are linked over a corpus.

A transducer reads both token streams of a text. Its state is the side that
leads and the bytes by which it leads (a dangling suffix); the next token comes
from the other side. Transitions are computed once for each state and token and
then looked up; a group closes whenever nothing dangles. A link is the pair of
tokens that end where a group closes. The two tokens cover the same bytes up to
that place, so one is a suffix of the other: a vocabulary has at most as many
such pairs as its tokens have bytes, whatever the corpus, which bounds the table
of link counts that is broadcast (about 520,000 rows for the two vocabularies
used here).

Null and empty texts, and texts of which one side's bytes aren't the text with
a space before it, have no tokens. Very long texts are one row, encoded whole.
Repeated rows are texts of their own. Other columns are kept, whatever their
names, unless they are named like an output, which is replaced.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.store import written
from graphloom.llm.textvec import arrow_limits, rounds

#: The columns that ``align`` adds.
ADDED = "n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups string, link_ids array<bigint>, link_ns array<int>"
#: Bits of an id of the second side in the number of a link.
B_BITS = 32
#: Text bytes that are tokenized together.
TOGETHER = 1 << 19


class State(dict):
    """Successors by the next token; unknown ones are made when first asked for."""

    def __init__(self, machine: Transducer, a_leads: bool, rest: bytes):
        self.machine, self.a_leads, self.rest = machine, a_leads, rest

    def __missing__(self, token: int) -> State:
        machine, rest = self.machine, self.rest
        if not rest:
            found = machine.state(True, machine.a_bytes[token])
        else:
            said = (machine.b_bytes if self.a_leads else machine.a_bytes)[token]
            if rest.startswith(said):
                found = machine.state(self.a_leads, rest[len(said) :])
            elif said.startswith(rest):
                found = machine.state(not self.a_leads, said[len(rest) :])
            else:
                raise ValueError("the sides differ")
        self[token] = found
        return found


class Transducer:
    """States are suffixes of tokens, so there are at most as many as the vocabularies have bytes."""

    def __init__(self, a_bytes: list[bytes], b_bytes: list[bytes]):
        self.a_bytes, self.b_bytes = a_bytes, b_bytes
        self.root = State(self, True, b"")
        self.states: dict[tuple[bool, bytes], State] = {}

    def state(self, a_leads: bool, rest: bytes) -> State:
        if not rest:
            return self.root
        key = (a_leads, rest)
        if key not in self.states:
            self.states[key] = State(self, a_leads, rest)
        return self.states[key]

    def closings(self, a: list[int], b: list[int]) -> tuple[list[int], list[int]]:
        """The numbers of tokens that either side has read when a group closes, for streams of equal bytes."""
        root, i, j, n = self.root, 0, 0, len(a)
        a_ends: list[int] = []
        b_ends: list[int] = []
        while i < n:
            now = root[a[i]]
            i += 1
            while now is not root:
                if now.a_leads:
                    now = now[b[j]]
                    j += 1
                else:
                    now = now[a[i]]
                    i += 1
            a_ends.append(i)
            b_ends.append(j)
        return a_ends, b_ends


def _unicode_bytes() -> dict[str, int]:
    """Byte-level vocabularies write each byte as a character: printable ones as they are, the others from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = {chr(b): b for b in shown}
    for n, b in enumerate(b for b in range(256) if b not in set(shown)):
        out[chr(0x100 + n)] = b
    return out


class ByteSide:
    """Byte-level ids of space + text. A rank file of the same vocabulary, if given, encodes faster, to the same ids."""

    def __init__(self, path: str, ranks: str | None, pattern: str | None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(path)
        self.slow.encode_special_tokens = True
        back = _unicode_bytes()
        special = {t.content for t in self.slow.get_added_tokens_decoder().values()}
        self.bytes = [b""] * self.slow.get_vocab_size()
        for token, i in self.slow.get_vocab().items():
            self.bytes[i] = token.encode() if token in special else bytes(back[c] for c in token)
        self.fast = None
        if ranks:
            import tiktoken

            with open(ranks, "rb") as f:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            if all(self.bytes[i] == token for token, i in table.items()):
                self.fast = tiktoken.Encoding("aligned", pat_str=pattern, mergeable_ranks=table, special_tokens={})

    def encode(self, texts: list[str]) -> list[list[int]]:
        if self.fast is not None:
            return [self._one(" " + t) for t in texts]
        return [e.ids for e in self.slow.encode_batch([" " + t for t in texts], add_special_tokens=False)]

    def _one(self, text: str) -> list[int]:
        try:
            return self.fast.encode_ordinary(text)
        except BaseException as error:  # The fast library's panics, on extremely long runs, aren't Exceptions.
            if type(error).__name__ != "PanicException" and not isinstance(error, ValueError):
                raise
            return self.slow.encode(text, add_special_tokens=False).ids


class PieceSide:
    """Ids of a sentencepiece model, which adds the space itself."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes = []
        for i in range(self.model.get_piece_size()):
            piece = self.model.id_to_piece(i)
            self.bytes.append(bytes([int(piece[1:-1], 16)]) if self.model.is_byte(i) else piece.replace("▁", " ").encode())

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


class Aligner:
    """Both sides, their transducer, and the texts that stand for their ids in ``groups``."""

    def __init__(self, a_path: str, b_path: str, a_ranks: str | None, a_pattern: str | None):
        self.a, self.b = ByteSide(a_path, a_ranks, a_pattern), PieceSide(b_path)
        self.machine = Transducer(self.a.bytes, self.b.bytes)
        shown = lambda n, end: np.array([f"{i}{end}" for i in range(n)], object)
        self.a_inner, self.a_last = shown(len(self.a.bytes), ","), shown(len(self.a.bytes), "|")
        self.b_inner, self.b_last = shown(len(self.b.bytes), ","), shown(len(self.b.bytes), ";")

    def one(self, raw: bytes, a: list[int], b: list[int]) -> tuple:
        """The added values of a text; ``raw`` is the text with a space before it."""
        same = b"".join(map(self.a.bytes.__getitem__, a)) == raw and b"".join(map(self.b.bytes.__getitem__, b)) == raw
        if not same or not a:
            return 0, 0, 0, 0, "", np.zeros(0, np.int64), np.zeros(0, np.int32)
        a_ends, b_ends = (np.array(x) for x in self.machine.closings(a, b))
        a, b = np.array(a), np.array(b)
        links, ns = np.unique(a[a_ends - 1] << B_BITS | b[b_ends - 1], return_counts=True)
        return len(a), len(b), len(a_ends), len(a_ends), self.shown(a, b, a_ends, b_ends), links, ns.astype(np.int32)

    def shown(self, a: np.ndarray, b: np.ndarray, a_ends: np.ndarray, b_ends: np.ndarray) -> str:
        """``a1,a2|b1;a3|b2,b3``: each id is put to the place that it has when the groups' sides take turns."""
        out = np.empty(len(a) + len(b), object)
        a_size, b_size = np.diff(a_ends, prepend=0), np.diff(b_ends, prepend=0)
        a_at = np.arange(len(a)) + np.repeat(b_ends - b_size, a_size)
        b_at = np.arange(len(b)) + np.repeat(a_ends, b_size)
        out[a_at], out[b_at] = self.a_inner[a], self.b_inner[b]
        out[a_at[a_ends - 1]], out[b_at[b_ends - 1]] = self.a_last[a[a_ends - 1]], self.b_last[b[b_ends - 1]]
        return "".join(out.tolist())[:-1]


_aligners: dict[tuple, Aligner] = {}


def align(docs: DataFrame, a_path: str, b_path: str, a_ranks: str | None = None, a_pattern: str | None = None, text: str = "text") -> DataFrame:
    """``docs`` with the numbers of tokens, groups and links, the ``groups`` as text, and different links with how often each occurs.

    ``link_ids`` are the first side's id times 2**32 plus the second side's.
    The files must exist on every executor.
    """
    arrow_limits(docs.sparkSession)
    added = [c.split()[0] for c in ADDED.split(", ")]
    kept = [c for c in docs.columns if c not in added]
    schema = docs.select(*kept, *(F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in ADDED.split(", "))).schema
    kinds = [pa.int64()] * 4 + [pa.string(), pa.list_(pa.int64()), pa.list_(pa.int32())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = (a_path, b_path, a_ranks, a_pattern)
        if key not in _aligners:
            _aligners[key] = Aligner(*key)
        own = _aligners[key]
        for batch in batches:
            for part in rounds(batch, text, TOGETHER):
                texts = [t or "" for t in part.column(text).to_pylist()]
                both = zip(texts, own.a.encode(texts), own.b.encode(texts), strict=True)
                made = [own.one((" " + t).encode(), a, b) if t else own.one(b"", [], []) for t, a, b in both]
                columns = [pa.array(values, kind) for values, kind in zip(zip(*made, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), *columns], schema=None, names=[*kept, *added])

    return docs.mapInArrow(run, schema)


def link_counts(aligned: DataFrame) -> DataFrame:
    """(link, n): how many links of all texts hold a pair of ids; counted before the shuffle, which moves at most all pairs that a vocabulary has once a task."""
    each = aligned.select(F.explode(F.arrays_zip("link_ids", "link_ns")).alias("l"))
    return each.groupBy(F.col("l.link_ids").alias("link")).agg(F.sum("l.link_ns").alias("n"))


def with_counts(aligned: DataFrame, counts: DataFrame) -> DataFrame:
    """``aligned`` with n_best, the links whose count is the highest of their second id's (ties included), and count_sum, the sum of all links' counts.

    ``counts`` has at most as many rows as the vocabularies have bytes (see
    above), so it goes to every task as one sorted array.
    """
    arrow_limits(aligned.sparkSession)
    table = counts.toArrow()
    links, ns = (table.column(c).to_numpy() for c in ("link", "n"))
    order = np.argsort(links)
    links, ns = links[order], ns[order]
    seconds = links & ((1 << B_BITS) - 1)
    most = np.zeros(int(seconds.max(initial=-1)) + 1, np.int64)
    np.maximum.at(most, seconds, ns)
    shared = aligned.sparkSession.sparkContext.broadcast((links, ns, ns == most[seconds]))
    kept = [c for c in aligned.columns if c not in ("n_best", "count_sum")]
    schema = aligned.select(*kept).schema.add("n_best", "long").add("count_sum", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, total, best = shared.value
        for batch in batches:
            lists = batch.column("link_ids")
            sizes = np.diff(lists.offsets.to_numpy())
            at = np.searchsorted(known, lists.flatten().to_numpy())
            times = batch.column("link_ns").flatten().to_numpy().astype(np.int64)
            ends = np.concatenate([[0], np.cumsum(sizes)])
            summed = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[ends])
            columns = [pa.array(summed(times * best[at])), pa.array(summed(times * total[at]))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *columns], [*kept, "n_best", "count_sum"])

    return aligned.mapInArrow(run, schema)


def corpus_alignment(docs: DataFrame, a_path: str, b_path: str, a_ranks: str | None = None, a_pattern: str | None = None, keep_text: bool = True, digest: Column | None = None) -> DataFrame:
    """``align`` and ``with_counts`` over one written table, with or without the texts; ``digest``, if given, is kept in place of ``groups``."""
    made = align(docs, a_path, b_path, a_ranks, a_pattern)
    made = made if keep_text else made.drop("text")
    if digest is not None:
        made = made.withColumn("groups", digest)
    table = written(made, "aligned")
    return with_counts(table, link_counts(table)).drop("link_ids", "link_ns")
