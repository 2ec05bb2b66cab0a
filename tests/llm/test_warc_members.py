"""The normaliser on foreign streams, and payloads above one inflated piece."""

import gzip
import io

from graphloom.llm import skew, warc_members


def record(name, body, length=True):
    head = ["WARC/1.0", f"WARC-Record-ID: <{name}>", *([f"Content-Length: {len(body)}"] if length else [])]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def test_foreign_streams(spark, tmp_path):
    bodies = {"a": b"", "b": b"\r\n\r\nWARC/1.0\r\n", "c": b"x" * (3 * warc_members.PIECE + 5)}
    records = [record(n, b) for n, b in bodies.items()]
    given = {
        "one": gzip.compress(b"".join(records)),
        "members": b"".join(map(gzip.compress, records)),
        "mixed": gzip.compress(records[0]) + gzip.compress(b"".join(records[1:])),
        "empty": gzip.compress(b""),
        "cut": gzip.compress(b"".join(records))[:-30],
        "short": gzip.compress(b"".join(records)[:-40]),
        "no_length": gzip.compress(records[0] + record("d", b"y", length=False)),
        "no_gzip": b"plain text",
        "bad_length": gzip.compress(records[0].replace(b": 0", b": many")),
    }
    for name, data in given.items():
        (tmp_path / f"{name}.warc.gz").write_bytes(data)
    archives = spark.createDataFrame([(f"{tmp_path}/{n}.warc.gz",) for n in given], "path string")
    found = {r.source.rpartition("/")[2].removesuffix(".warc.gz"): r for r in warc_members.normalise(archives, f"{tmp_path}/out").collect()}
    assert {n: r.n_records for n, r in found.items() if r.error is None} == {"one": 3, "members": 3, "mixed": 3, "empty": 0}
    assert all(found[n].path is None for n in ("cut", "short", "no_length", "no_gzip", "bad_length"))
    for name in ("one", "members", "mixed"):
        data = open(found[name].path, "rb").read()
        for line, want in zip(open(found[name].index_path), records, strict=True):
            offset, length, _ = line.split(" ", 2)
            assert gzip.GzipFile(fileobj=io.BytesIO(data[int(offset) : int(offset) + int(length)])).read() == want


def test_line_breaks_in_urls_and_large_payloads(spark):
    pages = [(1, "http://a/\r\nX: y", "z" * (2 * warc_members.PIECE)), (2, "http://b", "z" * (2 * warc_members.PIECE)), (3, None, None)]
    got = warc_members.round_trip(spark.createDataFrame([(*p, "x", 7) for p in pages], "page_id long, url string, html string, sha string, same long")).collect()
    assert sorted((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in got) == [(1, 2 * warc_members.PIECE, "response", None), (2, 2 * warc_members.PIECE, "revisit", 1), (3, 0, "response", None)]
    assert [r.url for r in got if r.page_id == 1] == ["http://a/%0D%0AX: y"]


def test_frequent_payloads(spark, monkeypatch):
    monkeypatch.setattr(skew, "PER_TASK", 3)
    pages = [(i, "u", "same" if i % 2 else f"p{i // 4}") for i in range(30)]
    got = {r.page_id: r.refers_to for r in warc_members.round_trip(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got == {i: (1 if i > 1 else None) if i % 2 else (i // 4 * 4 if i % 4 else None) for i in range(30)}
