"""Vectorised words, word hashes and shingles over Arrow string columns.

Words are maximal runs of bytes outside 0x20 and 0x09-0x0D. Every function
works on one flat byte buffer with document offsets, so a batch of many
documents costs a fixed number of numpy passes and no per-word Python.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BASE = U64(0x9E3779B97F4A7C15)
STEP = U64(0xD6E8FEB86659FD93)
#: The lowest 0 to 8 bytes of a number.
ONES = np.array([(1 << (8 * n)) - 1 for n in range(9)], U64)
#: Text bytes handled by one round of numpy calls; a longer document is a round of its own.
ROUND_BYTES = 1 << 20

_powers = np.ones(1, U64)
_inverse = np.ones(1, U64)


def arrow_limits(spark) -> None:
    """Bound the Arrow batches that Python workers get, whatever the length of the texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "512")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def rounds(batch: pa.RecordBatch, column: str, most: int = ROUND_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``most`` bytes of text each; every row lands in one slice."""
    _, off = flat(batch.column(column))
    start = 0
    while start < batch.num_rows:
        end = max(start + 1, int(np.searchsorted(off, off[start] + most, "right")) - 1)
        end = min(end, batch.num_rows)
        yield batch.slice(start, end - start)
        start = end


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, or binary values (null counts as empty), and len + 1 offsets into them."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, off - off[0]


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and the document of each."""
    if not len(data):
        return (np.zeros(0, np.int64),) * 3
    solid = ~SPACE[data]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    cut = off[:-1][off[:-1] < len(data)]
    first[cut] = solid[cut]
    last = solid.copy()
    last[:-1] &= ~solid[1:]
    cut = off[1:][off[1:] > 0] - 1
    last[cut] = solid[cut]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(off, starts, "right") - 1


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers, _inverse
    if len(_powers) < n:
        size = max(n, ROUND_BYTES + (1 << 16))
        back = U64(pow(int(BASE), -1, 1 << 64))
        made = []
        for by in (BASE, back):
            x = np.full(size, by, U64)
            x[0] = 1
            made.append(np.multiply.accumulate(x))
        if size > 16 * ROUND_BYTES:
            return made[0], made[1]
        _powers, _inverse = made
    return _powers, _inverse


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes: eight bytes at a time, each mixed with its place in the word, then summed.

    No power series of the bytes, which words such as Thue-Morse strings would defeat.
    """
    if not len(starts):
        return np.zeros(0, U64)
    size = ends - starts
    pieces = (size + 7) >> 3
    first = np.cumsum(pieces) - pieces
    place = np.arange(int(pieces.sum())) - np.repeat(first, pieces)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(data) + 1, np.dtype("<u8"), padded, strides=(1,))
    left = np.minimum(np.repeat(size, pieces) - 8 * place, 8)
    value = eight[np.repeat(starts, pieces) + 8 * place] & ONES[left]
    mixed = mix(value ^ mix(place.astype(U64) * STEP + BASE))
    return mix(np.add.reduceat(mixed, first) + size.astype(U64) * BASE)


def shingles(hashes: np.ndarray, doc: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word shingles and their documents, in order.

    A document of 1 to k - 1 words has one shingle, its whole sequence.
    """
    n = len(hashes)
    out_h, out_d = [], []
    weight = [U64(pow(int(STEP), j + 1, 1 << 64)) for j in range(k)]
    if n >= k:
        whole = doc[: n - k + 1] == doc[k - 1 :]
        acc = np.zeros(n - k + 1, U64)
        for j in range(k):
            acc += hashes[j : n - k + 1 + j] * weight[j]
        out_h.append(mix(acc[whole]))
        out_d.append(doc[: n - k + 1][whole])
    if n:
        at, count = np.unique(doc, return_index=True, return_counts=True)[1:]
        for r in range(1, k):
            short = at[count == r]
            if len(short):
                acc = np.full(len(short), r * int(BASE) % (1 << 64), U64)
                for j in range(r):
                    acc += hashes[short + j] * weight[j]
                out_h.append(mix(acc))
                out_d.append(doc[short])
    if not out_h:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    h, d = np.concatenate(out_h), np.concatenate(out_d)
    order = np.argsort(d, kind="stable")
    return h[order], d[order]


def shingle_sets(column: pa.Array, k: int) -> list[np.ndarray]:
    """For each text, lower-cased in A-Z, the sorted distinct hashes of its k-word shingles."""
    data, off = flat(column)
    data = LOWER[data]
    starts, ends, doc = words(data, off)
    h, d = shingles(word_hashes(data, starts, ends), doc, k)
    cut = np.searchsorted(d, np.arange(len(column) + 1))
    return [np.unique(h[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)]


def list_array(parts: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    """An Arrow list column of 64-bit numbers."""
    off = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(x) for x in parts], out=off[1:])
    values = np.concatenate(parts) if parts else np.zeros(0, U64)
    return pa.ListArray.from_arrays(pa.array(off), pa.array(values.view(np.int64), kind))
