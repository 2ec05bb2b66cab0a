"""Operator 2: exact merge-type SentencePiece encoding by backtracking, and decoding.

The model's bytes are read with a small protobuf reader. A text is a sequence
of segments, each a run of spaces and the characters up to the next space; no
piece crosses from a character to a following space, so segments are encoded
on their own and repeated ones come from a bounded cache.

Encoding a segment does not replay merges. Aho-Corasick matches give the
longest piece at each position; a piece is kept if re-merging it with the piece
before it leaves the boundary in place (both pieces are split back along their
own merges, and a merge across the boundary must never come first). If no
shorter piece fits, the position is marked in a bitfield as failed and the
piece before is shortened. Pieces that merging can't make are never offered.

Segments that hold pieces of equal score (in this model, runs of spaces) are
encoded by merging in order, since equal scores are resolved by place and not
by piece.

Null and empty texts give no ids. Nul bytes, U+2581 and characters outside
the vocabulary are kept: U+2581 decodes as a space, as the model defines, and
unknown characters become byte pieces.
"""

from __future__ import annotations

import heapq
import re
import struct
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.textvec import arrow_limits, rounds

SPACE = "▁"
#: Segments kept by a worker (twice as many for a while), the longest one that is kept, and pairs of pieces kept.
CACHE_ENTRIES, CACHE_CHARS, PAIR_ENTRIES = 300_000, 64, 500_000
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            x = data[at]
            at += 1
            value |= (x & 127) << shift
            shift += 7
            if x < 128:
                return value

    while at < len(data):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(key & 7) or varint()
            yield key >> 3, data[at : at + size]
            at += size


class BpeModel:
    """A merge-type model with identity normalisation; ``data`` is the model file's content."""

    def __init__(self, data: bytes):
        self.pieces: list[str] = []
        self.kinds: list[int] = []
        scores: list[float] = []
        trainer: dict[int, int | bytes] = {}
        rules: dict[int, int | bytes] = {}
        for number, value in _fields(data):
            if number == 1:
                piece = dict(_fields(value))
                self.pieces.append(piece.get(1, b"").decode())
                scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
                self.kinds.append(piece.get(3, NORMAL))
            elif number == 2:
                trainer = dict(_fields(value))
            elif number == 3:
                rules = dict(_fields(value))
        if trainer.get(3) != 2:
            raise ValueError("not a merge-type model")
        if rules.get(2) or rules.get(4, 1) or not rules.get(5, 1) or {USER_DEFINED, UNUSED} & set(self.kinds):
            raise ValueError("only identity normalisation without user-defined or unused pieces is supported")
        if not trainer.get(35):
            raise ValueError("the model has no byte fallback")
        if trainer.get(24):
            raise ValueError("pieces end, not start, with a space in this model")
        self.dummy_prefix = bool(rules.get(3, 1))
        self.byte_ids = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k == BYTE}
        self.id_of = {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k == NORMAL}
        self.newline_alone = not any("\n" in p for p in self.id_of)
        self.pairs: dict[tuple[str, str], bool] = {}
        if any(SPACE in p.lstrip(SPACE) for p in self.id_of):
            raise ValueError("a piece has a space after another character")
        self.score_of = {p: scores[i] for p, i in self.id_of.items()}
        seen: dict[float, int] = {}
        for p, s in self.score_of.items():
            if len(p) > 1:
                seen[s] = seen.get(s, 0) + 1
        self.tied = {p for p, s in self.score_of.items() if len(p) > 1 and seen[s] > 1}
        self.tied_words = [p for p in self.tied if p[0] != SPACE]
        merged = sorted((p for p in self.id_of if len(p) > 1 and p not in self.tied), key=lambda p: -self.score_of[p])
        #: Single characters come first, then pieces in the order of their merges.
        self.rank = {p: r for r, p in enumerate([*(p for p in self.id_of if len(p) == 1), *merged])}
        self._splits(merged)

    def _splits(self, merged: list[str]) -> None:
        """The last merge of each piece that merging makes; shorter ones first, so that both parts are known."""
        self.split: dict[str, tuple[str, str] | None] = {p: None for p in self.rank if len(p) == 1}
        for p in sorted(merged, key=len):
            last = self.merge(p)
            if len(last) == 1 and self._pair:
                self.split[p] = self._pair
        self.search = ahocorasick.Automaton()
        for p in self.split:
            self.search.add_word(p, (1 - len(p), p))
        self.search.make_automaton()
        #: The longest other piece that starts a piece.
        self.shorter: dict[str, str | None] = {}
        for p in self.split:
            self.shorter[p] = next((p[:n] for n in range(len(p) - 1, 0, -1) if p[:n] in self.split), None)

    def merge(self, text: str) -> list[str]:
        """Plain merging, best score first and leftmost among equals."""
        parts: list[str | None] = list(text)
        after = list(range(1, len(parts) + 1))
        before = list(range(-1, len(parts) - 1))
        heap: list[tuple[float, int, int]] = []
        score, self._pair = self.score_of, None

        def offer(a: int, b: int) -> None:
            if a >= 0 and b < len(parts) and (s := score.get(parts[a] + parts[b])) is not None:
                heapq.heappush(heap, (-s, a, len(parts[a]) + len(parts[b])))

        for i in range(len(parts) - 1):
            offer(i, i + 1)
        while heap:
            _, a, size = heapq.heappop(heap)
            if parts[a] is None or (b := after[a]) >= len(parts) or len(parts[a]) + len(parts[b]) != size:
                continue
            self._pair = parts[a], parts[b]
            parts[a] += parts[b]
            parts[b] = None
            after[a] = after[b]
            if after[b] < len(parts):
                before[after[b]] = a
            offer(before[a], a)
            offer(a, after[a])
        return [p for p in parts if p is not None]

    def compatible(self, left: str, right: str) -> bool:
        """Whether merging left and right together leaves the boundary between them; kept by pair."""
        got = self.pairs.get((left, right))
        if got is None:
            if len(self.pairs) >= PAIR_ENTRIES:
                self.pairs.clear()
            got = self.pairs[left, right] = self._remerged(left, right)
        return got

    def _remerged(self, left: str, right: str) -> bool:
        rank, split = self.rank, self.split
        if left not in rank or right not in rank:
            return True
        limit = len(rank) + 1
        while True:
            joined = rank.get(left + right)
            if joined is not None and joined < limit:
                return False
            a, b = rank[left], rank[right]
            cut_left, cut_right = split[left], split[right]
            if cut_left is not None and (a > b or cut_right is None):
                limit, left = a, cut_left[1]
            elif cut_right is not None:
                limit, right = b + 1, cut_right[0]
            else:
                return True

    def longest(self, text: str) -> list[str]:
        """The longest piece at each position; a character outside the vocabulary stands for itself."""
        best = list(text)
        # Matches come by their ends, so the last one from a position is its longest.
        for end, (back, p) in self.search.iter(text):
            best[end + back] = p
        return best

    def backtrack(self, text: str) -> list[str]:
        """Pieces of a segment without tied pieces."""
        best, shorter, pairs, total = self.longest(text), self.shorter, self.pairs, len(text)
        failed, any_failed = bytearray((total + 8) // 8), False
        out: list[str] = []
        last: str | None = None
        at = 0
        piece: str | None = best[0] if text else None
        while piece is not None:
            to = at + len(piece)
            if any_failed and failed[to >> 3] >> (to & 7) & 1:
                fits = False
            elif last is None:
                fits = True
            else:
                fits = pairs.get((last, piece))
                if fits is None:
                    fits = self.compatible(last, piece)
            if fits:
                out.append(piece)
                if to == total:
                    return out
                last, at, piece = piece, to, best[to]
                continue
            piece = shorter.get(piece)
            if piece is None:
                failed[at >> 3] |= 1 << (at & 7)
                any_failed = True
                if not out:
                    raise ValueError("no encoding")
                # Shorten the piece before; it is offered again and found to end at a failed position.
                piece = out.pop()
                at -= len(piece)
                last = out[-1] if out else None
        return out

    def segment_ids(self, segment: str) -> list[int]:
        if segment.startswith(SPACE + SPACE) or (self.tied_words and any(p in segment for p in self.tied_words)):
            pieces = self.merge(segment)
        else:
            pieces = self.backtrack(segment)
        try:
            return [self.id_of[p] for p in pieces]
        except KeyError:
            pass
        ids: list[int] = []
        for p in pieces:
            i = self.id_of.get(p)
            if i is None:
                ids.extend(self.byte_ids[b] for b in p.encode())
            else:
                ids.append(i)
        return ids


class _Segments(dict):
    """Packed ids of segments, in two generations so that frequent ones outlive a full cache."""

    def __init__(self, model: BpeModel):
        super().__init__()
        self.model, self.old = model, {}

    def __missing__(self, key: str) -> bytes:
        got = self.old.get(key)
        if got is None:
            ids = self.model.segment_ids(key) if key.startswith("\n") else self.model.segment_ids(SPACE + key)
            got = struct.pack(f"<{len(ids)}i", *ids)
        if len(key) <= CACHE_CHARS:
            if len(self) >= CACHE_ENTRIES:
                self.old = dict(self)
                self.clear()
            self[key] = got
        return got


class Codec:
    """Whole texts to ids and back, with a bounded cache of segments."""

    def __init__(self, model: BpeModel):
        self.model = model
        self.cache = _Segments(model)
        bare = [p.replace(SPACE, " ") if k == NORMAL else " ⁇ " if k == UNKNOWN else "" for p, k in zip(model.pieces, model.kinds, strict=True)]
        byte_of = {i: bytes([b]) for b, i in model.byte_ids.items()}
        data = [byte_of.get(i, t.encode()) for i, t in enumerate(bare)]
        self.is_byte = np.zeros(len(data), bool)
        self.is_byte[list(byte_of)] = True
        self.leads = np.array([k == NORMAL and t.startswith(" ") for t, k in zip(bare, model.kinds, strict=True)])
        self.size_of = np.array([len(d) for d in data])
        self.data_of = pa.array(data, pa.large_binary())

    def packed(self, text: str | None) -> bytes:
        """The ids of a text as little-endian 32-bit numbers."""
        if not text:
            return b""
        if SPACE in text:
            text = text.replace(SPACE, " ")
        # A newline is in no piece, so what follows it is a segment of its own.
        marked = text.replace("\n", " \n") if self.model.newline_alone else text
        if self.model.dummy_prefix and marked[0] != " " and marked[-1] != " " and "  " not in marked and (self.model.newline_alone or "\n" not in text):
            return b"".join(map(self.cache.__getitem__, marked.split(" ")))
        return self._spaced(text)

    def _spaced(self, text: str) -> bytes:
        """Texts with runs of spaces, or with spaces at an end."""
        if self.model.dummy_prefix:
            text = " " + text
        out: list[int] = []
        for segment in re.findall(r" *[^ ]+| +", text):
            out.extend(self.model.segment_ids(segment.replace(" ", SPACE)))
        return struct.pack(f"<{len(out)}i", *out)

    def ids(self, text: str | None) -> list[int]:
        return np.frombuffer(self.packed(text), "<i4").tolist()

    def encode_column(self, texts: pa.Array) -> pa.Array:
        parts = [self.packed(t) for t in texts.to_pylist()]
        off = np.zeros(len(parts) + 1, np.int32)
        np.cumsum([len(p) >> 2 for p in parts], out=off[1:])
        return pa.ListArray.from_arrays(pa.array(off), pa.array(np.frombuffer(b"".join(parts), "<i4")))

    def decode_column(self, lists: pa.Array) -> pa.Array:
        """Texts of lists of ids: the pieces' bytes put together, without the added first space."""
        off = np.concatenate([[0], np.cumsum(np.nan_to_num(pc.list_value_length(lists).to_numpy(zero_copy_only=False)))]).astype(np.int64)
        ids = lists.flatten().to_numpy(zero_copy_only=False)
        ends = np.zeros(len(ids) + 1, np.int64)
        np.cumsum(self.size_of[ids], out=ends[1:])
        data = self.data_of.take(pa.array(ids)).buffers()[2]
        data = data.to_pybytes()[: ends[-1]] if data is not None else b""
        starts, stops = ends[off[:-1]].copy(), ends[off[1:]]
        if self.model.dummy_prefix:
            for i in np.flatnonzero(stops > starts):
                shown = off[i] + np.argmax(self.size_of[ids[off[i] : off[i + 1]]] > 0)
                starts[i] += int(self.leads[ids[shown]])
        bytes_in = np.zeros(len(ids) + 1, np.int64)
        np.cumsum(self.is_byte[ids], out=bytes_in[1:])
        out = []
        for i in range(len(lists)):
            part = data[starts[i] : stops[i]]
            try:
                out.append(part.decode())
            except UnicodeDecodeError:
                out.append(self._repaired(ids[off[i] : off[i + 1]]))
        return pa.array(out, pa.string())

    def _repaired(self, ids: np.ndarray) -> str:
        """Texts whose byte pieces aren't all valid: each run of them is decoded on its own."""
        out, pending, begin = [], bytearray(), self.model.dummy_prefix
        for i in ids.tolist():
            piece = self.data_of[i].as_py()
            if self.is_byte[i]:
                pending += piece
                continue
            if pending:
                out.append(_utf8(pending))
                begin = False
                pending.clear()
            text = piece.decode()
            if begin and text:
                begin = False
                text = text[int(self.leads[i]) :]
            out.append(text)
        if pending:
            out.append(_utf8(pending))
        return "".join(out)

    def decode(self, ids: list[int]) -> str:
        return self.decode_column(pa.array([ids], pa.list_(pa.int32())))[0].as_py()


def _utf8(data: bytearray) -> str:
    """Each byte that starts no valid character becomes one U+FFFD."""
    try:
        return data.decode()
    except UnicodeDecodeError:
        pass
    out, at = [], 0
    while at < len(data):
        for n in (1, 2, 3, 4):
            try:
                out.append(data[at : at + n].decode())
                at += n
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            at += 1
    return "".join(out)


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """One codec a worker and model file."""
    if path not in _codecs:
        with open(path, "rb") as f:
            _codecs[path] = Codec(BpeModel(f.read()))
    return _codecs[path]


def encode(df: DataFrame, model_path: str, text: str = "text", out: str = "ids") -> DataFrame:
    """``df`` with the ids of each whole text as ``out``; a column of that name is replaced.

    Null and empty texts get an empty list. ``model_path`` must exist on every executor.
    """
    return _mapped(df, text, out, "array<int>", Codec.encode_column, model_path, text)


def decode(df: DataFrame, model_path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``df`` with the text of each list of ids as ``out``; null and empty lists give an empty text."""
    return _mapped(df, ids, out, "string", Codec.decode_column, model_path, None)


def round_trip(df: DataFrame, model_path: str, text: str = "text", ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``df`` with the ids of each whole text and the text that these decode to; columns of those names are replaced.

    Both are made in one pass, so a task needs one Python worker that holds the
    model, not two. Rows and texts are as in ``encode`` and ``decode``.
    """
    arrow_limits(df.sparkSession)
    kept = [c for c in df.columns if c not in (ids, out)]
    schema = df.select(*kept, F.lit(None).cast("array<int>").alias(ids), F.lit(None).cast("string").alias(out)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model_path)
        for batch in batches:
            for part in rounds(batch, text):
                found = own.encode_column(part.column(text))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), found, own.decode_column(found)], [*kept, ids, out])

    return df.mapInArrow(run, schema)


def _mapped(df: DataFrame, source: str, out: str, kind: str, method, path: str, by: str | None) -> DataFrame:
    arrow_limits(df.sparkSession)
    kept = [c for c in df.columns if c != out]
    schema = df.select(*kept, F.lit(None).cast(kind).alias(out)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            slices = rounds(batch, by) if by else (batch.slice(i, 64) for i in range(0, batch.num_rows, 64))
            for part in slices:
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), method(own, part.column(source))], [*kept, out])

    return df.mapInArrow(run, schema)


def sha_of_ids(ids: Column) -> Column:
    return F.sha2(F.array_join(ids.cast("array<string>"), ",").cast("binary"), 256)
