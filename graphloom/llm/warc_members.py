"""Operator 10: WARC writing, and the normaliser that gives every record its own gzip member.

``write_archives`` makes whole-file gzip streams: one member with many records,
as tools do that compress a finished archive. ``normalise`` inflates each such
stream once, in pieces of bounded size, writes every record as a member of its
own to a new file, and a sidecar index of (offset, length, record id) beside
it. ``read_records`` seeks by the index and inflates single members.

Files go to a folder that all executors share, through Arrow's file systems, so
the folder may be any URI that these know. A file's name holds its partition
and task attempt; only names that a finished task returned are used later, so
an attempt that was lost leaves nothing that counts.

A stream that is cut short, isn't gzip, or has a record without a length or id
is put in quarantine whole: its row has the error and no path. ``round_trip``
fails if one of its own archives does.

Of records with equal payloads (by SHA-256) the one with the smallest page_id is a response
and the others are revisits that name it, unless the payload is shorter than
``least``. Groups of equal payloads meet only as one row a group and task.
Null html counts as an empty payload; null urls as an empty target. Rows that
repeat a page_id are records of their own; the first of equal ones is by page
id alone, so all of them are responses. Payloads of any length are read and
written whole, in pieces where they are inflated. Extra columns aren't read; an
empty table has no archive.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.skew import hot_keys, salted_join
from graphloom.llm.store import fresh_path, written
from graphloom.llm.textvec import arrow_limits

#: Bytes inflated at a time, and payload bytes after which an archive is closed.
PIECE, ARCHIVE_BYTES = 1 << 18, 64 << 20
#: Payload bytes from which equal payloads become revisits.
LEAST = 0
#: Tasks at least that archives are dealt over, if there are as many.
TASKS = 200
EPOCH = "2020-01-01T00:00:00Z"


def classified(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """page_id, url, payload, sha (hex), refers_to (null for responses)."""
    base = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload"))
    base = base.withColumns({"sha": F.sha1("payload"), "same": F.sha2("payload", 256)})
    first = base.select("page_id", "same").groupBy("same").agg(F.min("page_id").alias("first_id"), F.count("*").alias("copies"))
    shared = written(first.where("copies > 1"), "shared")
    joined = salted_join(base, shared.drop("copies"), "same", ["page_id", "url"], hot_keys(shared, "same", "copies"), "left")
    later = (F.length("payload") >= least) & (F.col("page_id") > F.col("first_id"))
    return joined.select("page_id", "url", "payload", "sha", F.when(later, F.col("first_id")).alias("refers_to"))


def _record(page_id: int | None, url: str, payload: bytes, sha: str, refers_to: int | None) -> bytes:
    digest = base64.b32encode(bytes.fromhex(sha)).decode()
    clean = url.replace("\r", "%0D").replace("\n", "%0A")
    body = b"" if refers_to is not None else payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Target-URI: {clean}",
        f"WARC-Date: {EPOCH}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Length: {len(payload)}",
        "Content-Type: text/html",
        f"Content-Length: {len(body)}",
    ]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def _open(uri: str):
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def _attempt() -> str:
    context = TaskContext.get()
    return f"{context.partitionId():06d}-{context.taskAttemptId()}"


def write_archives(records: DataFrame, folder: str, most: int = ARCHIVE_BYTES) -> DataFrame:
    """Write ``classified`` records as whole-file gzip streams; returns (path, n_records)."""
    arrow_limits(records.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _open(folder)
        system.create_dir(root, recursive=True)
        out, number, count, size, path = None, 0, 0, 0, ""

        def closed() -> pa.RecordBatch:
            out[1].close()
            out[0].close()
            return pa.RecordBatch.from_pydict({"path": [path], "n_records": pa.array([count], pa.int64())})

        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    path = f"{folder}/whole-{_attempt()}-{number:04d}.warc.gz"
                    stream = system.open_output_stream(f"{root}/{path.rpartition('/')[2]}", compression=None)
                    out, count, size = (stream, gzip.GzipFile(fileobj=stream, mode="wb", mtime=0, compresslevel=3)), 0, 0
                out[1].write(_record(**row))
                count, size = count + 1, size + len(row["payload"])
                if size >= most:
                    yield closed()
                    out, number = None, number + 1
        if out is not None:
            yield closed()

    return records.select("page_id", "url", "payload", "sha", "refers_to").mapInArrow(run, "path string, n_records long")


class _Inflated:
    """Reads of an inflated stream that may have any number of members."""

    def __init__(self, stream):
        self.stream, self.buffer, self.engine, self.ended = stream, bytearray(), zlib.decompressobj(31), False

    def _more(self) -> bool:
        while not self.ended:
            data = self.engine.unused_data if self.engine.eof else self.engine.unconsumed_tail
            if self.engine.eof:
                data = data or self.stream.read(PIECE)
                if not data:
                    self.ended = True
                    return False
                self.engine = zlib.decompressobj(31)
            elif not data:
                data = self.stream.read(PIECE)
                if not data:
                    raise EOFError("a gzip stream ends before its trailer")
            got = self.engine.decompress(data, PIECE)
            if got:
                self.buffer += got
                return True
        return False

    def until(self, mark: bytes) -> bytes | None:
        """Bytes up to and with ``mark``; None at the end."""
        seen = 0
        while (at := self.buffer.find(mark, max(0, seen - len(mark)))) < 0:
            seen = len(self.buffer)
            if not self._more():
                if self.buffer.strip():
                    raise EOFError("a record's header has no end")
                return None
        out = bytes(self.buffer[: at + len(mark)])
        del self.buffer[: at + len(mark)]
        return out

    def pieces(self, n: int) -> Iterator[bytes]:
        while n:
            if not self.buffer and not self._more():
                raise EOFError("a record ends before its length")
            out = bytes(self.buffer[:n])
            del self.buffer[: len(out)]
            n -= len(out)
            yield out


def _headers(block: bytes) -> dict[str, str]:
    lines = block.decode("utf-8", "replace").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:] if line)}


def split_members(source, target) -> list[tuple[int, int, str]]:
    """Rewrite every record of ``source`` as a member of ``target``; (offset, length, record id) of each."""
    stream, index, offset = _Inflated(source), [], 0
    while True:
        head = stream.until(b"\r\n\r\n")
        if head is None:
            return index
        head = head.lstrip(b"\r\n")
        if not head:
            continue
        headers = _headers(head)
        engine, size = zlib.compressobj(6, zlib.DEFLATED, 31), 0
        size += target.write(engine.compress(head))
        for piece in stream.pieces(int(headers["content-length"])):
            size += target.write(engine.compress(piece))
        stream.until(b"\r\n\r\n")
        size += target.write(engine.compress(b"\r\n\r\n") + engine.flush())
        index.append((offset, size, headers["warc-record-id"]))
        offset += size


class _Counted:
    """A stream whose ``write`` says how many bytes it took."""

    def __init__(self, stream):
        self.stream = stream

    def write(self, data: bytes) -> int:
        if data:
            self.stream.write(data)
        return len(data)


def normalise(archives: DataFrame, folder: str) -> DataFrame:
    """Normalise each archive named in ``archives.path``; returns (source, path, index_path, n_records, error)."""

    def one(source_path: str) -> tuple:
        system, root = _open(folder)
        name = source_path.rpartition("/")[2].removesuffix(".warc.gz") + f"-{_attempt()}"
        from_system, from_path = _open(source_path)
        try:
            with from_system.open_input_stream(from_path, compression=None) as source, system.open_output_stream(f"{root}/{name}.warc.gz", compression=None) as target:
                index = split_members(source, _Counted(target))
        except (EOFError, KeyError, ValueError, zlib.error) as error:
            system.delete_file(f"{root}/{name}.warc.gz")
            return source_path, None, None, 0, f"{type(error).__name__}: {error}"
        lines = "".join(f"{offset} {length} {record}\n" for offset, length, record in index)
        with system.open_output_stream(f"{root}/{name}.idx", compression=None) as out:
            out.write(lines.encode())
        return source_path, f"{folder}/{name}.warc.gz", f"{folder}/{name}.idx", len(index), None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _open(folder)
        system.create_dir(root, recursive=True)
        names = ["source", "path", "index_path", "n_records", "error"]
        kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.string()]
        for batch in batches:
            for path in batch.column("path").to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(one(path), kinds, strict=True)], names)

    return archives.select("path").mapInArrow(run, "source string, path string, index_path string, n_records long, error string")


RECORD = "page_id long, url string, record_type string, payload binary, payload_bytes long, payload_digest string, refers_to long"


def read_records(members: DataFrame) -> DataFrame:
    """The records of normalised archives, by their indexes; revisits have no payload of their own.

    A response's length and digest are those of the body that was read; a header that says otherwise is an error.
    """
    number = lambda x: int(x) if (x := x.removeprefix("<urn:page:").removesuffix(">")) else None
    names = [x.split(" ")[0] for x in RECORD.split(", ")]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.int64()]

    def made(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, index_path in zip(batch.column("path").to_pylist(), batch.column("index_path").to_pylist(), strict=True):
                system, own = _open(path)
                with system.open_input_stream(_open(index_path)[1], compression=None) as f:
                    entries = [line.split(" ", 2) for line in io.TextIOWrapper(io.BytesIO(f.read()), "utf-8").read().splitlines()]
                rows, size = [], 0
                with system.open_input_file(own) as f:
                    for offset, length, _ in entries:
                        f.seek(int(offset))
                        head, _, rest = gzip.decompress(f.read(int(length))).partition(b"\r\n\r\n")
                        h = _headers(head)
                        body = rest[: int(h["content-length"])]
                        told = int(h["x-payload-length"]), h["warc-payload-digest"].removeprefix("sha1:")
                        if h["warc-type"] == "response" and told != (found := (len(body), base64.b32encode(hashlib.sha1(body).digest()).decode())):
                            raise ValueError(f"{own}: a payload was read back as {found}, but written as {told}")
                        rows.append((number(h["warc-record-id"]), h["warc-target-uri"], h["warc-type"], body, *told, number(h["warc-refers-to"]) if "warc-refers-to" in h else None))
                        size += len(body)
                        if size >= 8 << 20 or len(rows) >= 512:
                            yield made(rows)
                            rows, size = [], 0
                if rows:
                    yield made(rows)

    return members.mapInArrow(run, RECORD)


def _dealt(archives: DataFrame) -> DataFrame:
    """The rows of a written table of archives over as many tasks, or as many as keep the cluster busy."""
    spark = archives.sparkSession
    tasks = max(TASKS, 4 * spark.sparkContext.defaultParallelism)
    return archives.repartitionByRange(max(1, min(archives.count(), tasks)), "path")


def round_trip(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """Write ``pages`` as archives, normalise these and read them back."""
    spark = pages.sparkSession
    folder = fresh_path(spark, "warc")
    whole = written(write_archives(classified(pages, least), f"{folder}/whole"), "archives")
    members = written(normalise(_dealt(whole), f"{folder}/members"), "members")
    broken = members.where("error is not null").first()
    if broken:
        raise ValueError(f"{broken.source}: {broken.error}")
    return read_records(_dealt(members))
