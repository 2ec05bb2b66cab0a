import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from graphloom.llm import suffix_dedup, suffix_sort


def brute(rows, length=suffix_dedup.LENGTH):
    """(doc_id, n_bytes, n_removed, n_spans, sha) of each row, from all strings of all rows."""
    low = -(1 << 63)
    first = {}
    for doc, text in rows:
        raw = (text or "").encode()
        for p in range(len(raw) - length + 1):
            s = raw[p : p + length]
            first[s] = min(first.get(s, 1 << 63), low if doc is None else doc)
    out = []
    for doc, text in rows:
        raw = (text or "").encode()
        gone = [False] * len(raw)
        for p in range(len(raw) - length + 1):
            if first[raw[p : p + length]] < (low if doc is None else doc):
                gone[p : p + length] = [True] * length
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((doc, len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def key(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r))


def compare(spark, rows):
    got = suffix_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string"))
    found = [tuple(r) for r in got.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()]
    assert key(found) == key(brute(rows))


def test_blind_trie_orders_strings():
    rng = random.Random(3)
    for _ in range(200):
        strings = [bytes(rng.choice(b"ab\x00") for _ in range(12)) for _ in range(rng.randint(1, 60))]
        groups = suffix_sort.blind_trie(strings)
        assert [strings[g[0]] for g in groups] == sorted(set(strings))
        assert all(strings[i] == strings[g[0]] for g in groups for i in g) and sorted(i for g in groups for i in g) == list(range(len(strings)))


def test_suffix_order(monkeypatch):
    monkeypatch.setattr(suffix_sort, "SMALL", 50)
    rng = random.Random(5)
    data = np.frombuffer(bytes(rng.choice(b"abc") for _ in range(3000)) + b"x" * 40 + bytes(rng.choice(b"ab") for _ in range(200)), np.uint8)
    at = np.array([p for p in range(len(data) - 50) for _ in range(1 + p % 2)])
    kinds = suffix_sort.equal_suffixes(data, at, np.full(len(at), 50), [])
    order = {s: i for i, s in enumerate(sorted({data[p : p + 50].tobytes() for p in at}))}
    assert kinds.tolist() == [order[data[p : p + 50].tobytes()] for p in at]


def test_given_documents_against_brute_force(spark):
    compare(spark, [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()])


def test_hot_anchors_and_small_buffers(spark, monkeypatch):
    """Anchors of more than five documents are hot, and buffers hold a few groups."""
    monkeypatch.setattr(suffix_dedup, "HOT", 5)
    monkeypatch.setattr(suffix_dedup, "BUFFER", 2000)
    rng = random.Random(2)
    base = " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(60))
    rows = [(i, base if i % 3 else base[: 20 * i % 300] + str(i) + base[20 * i % 300 :]) for i in range(40)]
    compare(spark, [*rows, (3, base), (50, "x" + base[40:160] + "y"), (51, base * 3)])


def test_edges(spark):
    passage = "the quick brown fox jumps over the lazy dog and then rests a while"
    rows = [
        (5, "zero " + passage + " tail"),
        (2, "head " + passage),
        (2, passage + " again under the same id"),
        (2, "head " + passage),
        (None, passage),
        (9, None),
        (8, ""),
        (7, "short"),
        (11, "a" * 400),
        (12, "a" * 300 + "b" * 100),
        (13, "é" * 40),
        (14, "xé" + "é" * 40),
        (15, "head " + passage[:30] + "é" + passage[30:]),
    ]
    compare(spark, rows)
    compare(spark, rows[5:8])
    assert suffix_dedup.dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("seed", range(2))
def test_against_brute_force(spark, seed):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 9))) for _ in range(60)]
    parts = [" ".join(rng.choices(words, k=rng.randint(4, 40))) for _ in range(12)]
    rows = [(rng.randrange(60), " ".join(rng.choice(parts) if rng.random() < 0.6 else rng.choice(words) for _ in range(rng.randint(1, 12)))) for _ in range(70)]
    compare(spark, rows)


def test_buffers_hold_whole_groups(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BUFFER", 300)
    keys = sorted(random.Random(1).choices(range(12), k=200))
    given = pa.RecordBatch.from_pydict({"key": pa.array(keys, pa.int64()), "salt": pa.array([k % 2 for k in keys], pa.int32())})
    out = [b.column("key").to_pylist() for b in suffix_dedup._whole_groups(given.slice(i, 7) for i in range(0, 200, 7))]
    assert sum(out, []) == keys and len(out) > 3
    assert all(a[-1] != b[0] for a, b in zip(out, out[1:], strict=False))
