"""WARC archives as a Spark data source, format ``warc``.

Reading: the driver plans partitions of whole files (small ones together). Predicates on record
type and on the header columns are pushed down. A task parses a record's headers first, by
inflating no more than the start of its gzip member, and decodes the payload only if the headers
pass and payloads are wanted (option ``payload``, default true). Members that carry their
compressed size in the gzip extra field ``SL``, as this writer's do, are skipped without being
inflated at all; other archives, plain or compressed, are read too.

Writing: one gzip member per record, files rolled over at ``FILE_BYTES``. Tasks write files under
names of their own and the commit lists those of successful tasks in ``_manifest.json``, which is
all that a reader looks at: a lost or repeated task leaves nothing that is read.

Files are reached through ``pyarrow.fs``, so a folder may be local and shared, or a URI.

Behaviour at the edges: null payloads count as empty, null urls leave out the header, control
characters in urls are percent-encoded; null page ids are written as such and read back as null.
Of rows with equal payloads the one with the largest page_id is the response and others revisit
it; rows repeating that page_id are responses too, and if nobody has an id all are responses. Headers
may be of any length. A member whose size in ``SL`` is none that a member can have, or that ends
early, is an error; one without the end of its headers is no record. Other columns are ignored; an
empty table gives an archive without records.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, StringStartsWith, WriterCommitMessage
from pyspark.sql.types import StructType

from lectern.llm.common import hot_keys, new_path, scratch, spread_join, written

FILE_BYTES, PARTITION_BYTES, BATCH_BYTES, WINDOW = 256 << 20, 64 << 20, 8 << 20, 4 << 20
MANIFEST = "_manifest.json"
#: Bytes of the header of a member with an extra field SL, and of the least member of that kind.
HEAD_BYTES, LEAST_MEMBER = 24, 34
SCHEMA = "record_type string, record_id string, target_uri string, payload_digest string, refers_to string, full_length long, headers map<string,string>, payload binary, actual_digest string"
ARROW = pa.schema([(c, pa.string()) for c in ("record_type", "record_id", "target_uri", "payload_digest", "refers_to")] + [("full_length", pa.int64()), ("headers", pa.map_(pa.string(), pa.string())), ("payload", pa.binary()), ("actual_digest", pa.string())])
#: Columns that are headers, and so can be decided before the payload is touched.
HEADER_OF = {"record_type": "warc-type", "record_id": "warc-record-id", "target_uri": "warc-target-uri", "payload_digest": "warc-payload-digest", "refers_to": "warc-refers-to"}
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


# -- writing ----------------------------------------------------------------------------------


def member(data: bytes, level: int = 5) -> bytes:
    """One gzip member whose extra field SL holds its compressed and plain sizes."""
    deflate = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = deflate.compress(data) + deflate.flush()
    size = 24 + len(body) + 8
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H2sHII", 12, b"SL", 8, size, len(data)) + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def record(kind: str, record_id: str, uri: str | None, payload: bytes, digest: str, full_length: int, refers_to: str | None, date: str) -> bytes:
    block = HTTP % len(payload) + payload if kind == "response" else b""
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {date}"]
    if uri is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", uri))
    lines += [f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {full_length}"]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <{refers_to}>", f"WARC-Profile: {PROFILE}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class Files(WriterCommitMessage):
    def __init__(self, names: list[str]):
        self.names = names


class WarcWriter(DataSourceArrowWriter):
    """Rows of record_type, record_id, target_uri, payload, payload_digest (hex SHA-1), full_length, refers_to."""

    def __init__(self, path: str, options: dict):
        self.path, self.date = path, options.get("date", "1970-01-01T00:00:00Z")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Files:
        fs, at = filesystem(self.path)
        fs.create_dir(at, recursive=True)
        names, out, size = [], None, 0
        for batch in iterator:
            cols = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            for i in range(batch.num_rows):
                x = {n: c[i].as_py() for n, c in cols.items()}
                digest = base64.b32encode(bytes.fromhex(x["payload_digest"])).decode()
                data = member(record(x["record_type"], x["record_id"], x["target_uri"], x["payload"] or b"", digest, x["full_length"], x["refers_to"], self.date))
                if out is None or size + len(data) > FILE_BYTES:
                    if out:
                        out.close()
                    names.append(f"{uuid.uuid4().hex}.warc.gz")
                    out, size = fs.open_output_stream(f"{at}/{names[-1]}", compression=None), 0
                out.write(data)
                size += len(data)
        if out:
            out.close()
        return Files(names)

    def commit(self, messages: list) -> None:
        fs, at = filesystem(self.path)
        fs.create_dir(at, recursive=True)
        with fs.open_output_stream(f"{at}/{MANIFEST}", compression=None) as out:
            out.write(json.dumps(sorted(n for m in messages if m for n in m.names)).encode())

    def abort(self, messages: list) -> None:
        fs, at = filesystem(self.path)
        for name in (n for m in messages if m for n in m.names):
            fs.delete_file(f"{at}/{name}")


# -- reading ----------------------------------------------------------------------------------


class WarcFiles(InputPartition):
    def __init__(self, paths: list[str]):
        super().__init__(paths)
        self.paths = paths


class Window:
    """Reads at any place of a file through a window of WINDOW bytes."""

    def __init__(self, file):
        self.file, self.size, self.start, self.data = file, file.size(), 0, b""

    def read(self, n: int, at: int) -> bytes:
        if not (self.start <= at and at + n <= self.start + len(self.data)):
            self.start = at
            self.data = self.file.read_at(min(max(n, WINDOW), self.size - at), at)
        return self.data[at - self.start : at - self.start + n]


def parsed_headers(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:] if ":" in x)}


def value_of(headers: dict[str, str], column: str) -> str | None:
    value = headers.get(HEADER_OF[column])
    if value is not None and column in ("record_id", "refers_to"):
        value = value.strip("<>")
    return value


def payload_of(headers: dict[str, str], block: bytes) -> bytes:
    if headers.get("content-type", "").startswith("application/http"):
        return block.partition(b"\r\n\r\n")[2]
    return block


def records(file, wants, with_payload: bool) -> Iterator[tuple[dict[str, str], bytes | None]]:
    """(headers, payload or None) of the records whose headers pass ``wants``."""
    window, at = Window(file), 0
    while at < window.size:
        start = window.read(min(24, window.size - at), at)
        if start[:2] != b"\x1f\x8b":
            step = _plain(window, at, wants, with_payload)
        elif start[3:4] == b"\x04" and start[12:14] == b"SL":
            step = _sized(window, at, struct.unpack("<I", start[16:20])[0], wants, with_payload)
        else:
            step = _unsized(window, at, wants, with_payload)
        at, found = step
        if found:
            yield found


def _plain(window: Window, at: int, wants, with_payload: bool):
    n, head = 4096, b""
    while (end := head.find(b"\r\n\r\n")) < 0:
        if len(head) == window.size - at:
            return window.size, None
        head = window.read(min(n, window.size - at), at)
        n *= 4
    headers = parsed_headers(head[:end])
    length = int(headers.get("content-length", 0))
    body, found = at + end + 4, None
    if wants(headers):
        found = headers, payload_of(headers, window.read(min(length, window.size - body), body)) if with_payload else None
    return body + length + 4, found


class Member:
    """The plain bytes of a gzip member of known size, inflated as far as they are asked for."""

    def __init__(self, window: Window, at: int, size: int):
        if size < LEAST_MEMBER or at + size > window.size:
            raise ValueError(f"gzip member at {at} can't have {size} bytes")
        self.window, self.at, self.end = window, at + HEAD_BYTES, at + size - 8
        self.inflate, self.waiting = zlib.decompressobj(-15), b""

    def more(self, most: int) -> bytes:
        """Up to ``most`` further bytes, none at the member's end."""
        while not self.inflate.eof:
            if not self.waiting:
                n = min(4096 if most <= 4096 else WINDOW, self.end - self.at)
                self.waiting = self.window.read(n, self.at)
                self.at += n
                if not n:
                    raise ValueError("gzip member ends early")
            out = self.inflate.decompress(self.waiting, most)
            self.waiting = self.inflate.unconsumed_tail
            if out:
                return out
        return b""

    def rest(self) -> bytes:
        return b"".join(iter(lambda: self.more(WINDOW), b""))


def _sized(window: Window, at: int, size: int, wants, with_payload: bool):
    member, head, end = Member(window, at, size), bytearray(), -1
    while end < 0 and (part := member.more(2048)):
        head += part
        end = head.find(b"\r\n\r\n", max(0, len(head) - len(part) - 3))
    if end < 0:  # no record
        return at + size, None
    headers = parsed_headers(bytes(head[:end]))
    if not wants(headers):
        return at + size, None
    if not with_payload:
        return at + size, (headers, None)
    block = bytes(head[end + 4 :]) + member.rest()
    return at + size, (headers, payload_of(headers, block[: int(headers.get("content-length", 0))]))


def _unsized(window: Window, at: int, wants, with_payload: bool):
    """A member that doesn't tell its size: inflated to its end, kept only if wanted."""
    inflate, kept, headers, plain = zlib.decompressobj(31), [], None, b""
    while not inflate.eof and at < window.size:
        data = window.read(min(1 << 16, window.size - at), at)
        at += len(data)
        part = inflate.decompress(data)
        if headers is None:
            plain += part
            if (end := plain.find(b"\r\n\r\n")) < 0:
                continue
            headers, part = parsed_headers(plain[:end]), plain[end + 4 :]
            wanted = wants(headers)
        if wanted and with_payload:
            kept.append(part)
    at -= len(inflate.unused_data)
    if headers is None or not wanted:
        return at, None
    return at, (headers, payload_of(headers, b"".join(kept)[: int(headers.get("content-length", 0))]) if with_payload else None)


class WarcReader(DataSourceReader):
    def __init__(self, path: str, options: dict):
        self.path, self.with_payload = path, options.get("payload", "true").lower() == "true"
        self.tests: list[tuple[str, str, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            column = getattr(f, "attribute", ("",))
            name = column[0] if len(column) == 1 and column[0] in HEADER_OF else None
            if name and isinstance(f, (EqualTo, StringStartsWith)):
                self.tests.append((name, type(f).__name__, f.value))
            elif name and isinstance(f, In):
                self.tests.append((name, "In", tuple(f.value)))
            elif name and isinstance(f, IsNotNull):
                self.tests.append((name, "IsNotNull", None))
            else:
                yield f

    def wants(self, headers: dict[str, str]) -> bool:
        for name, kind, value in self.tests:
            own = value_of(headers, name)
            if own is None or not (kind == "IsNotNull" or kind == "EqualTo" and own == value or kind == "In" and own in value or kind == "StringStartsWith" and own.startswith(value)):
                return False
        return True

    def partitions(self) -> list[WarcFiles]:
        fs, at = filesystem(self.path)
        if fs.get_file_info(f"{at}/{MANIFEST}").is_file:
            with fs.open_input_stream(f"{at}/{MANIFEST}", compression=None) as f:
                found = [f"{at}/{n}" for n in json.loads(f.read())]
            infos = fs.get_file_info(found)
        elif (info := fs.get_file_info(at)).is_file:
            infos = [info]
        else:
            infos = [x for x in fs.get_file_info(pafs.FileSelector(at)) if x.is_file and re.search(r"\.warc(\.gz)?$", x.path)]
        groups, size = [[]], 0
        for x in sorted(infos, key=lambda x: x.path):
            if groups[-1] and size + x.size > PARTITION_BYTES:
                groups.append([])
                size = 0
            groups[-1].append(x.path)
            size += x.size
        return [WarcFiles(g) for g in groups]

    def read(self, partition: WarcFiles) -> Iterator[pa.RecordBatch]:
        fs, _ = filesystem(self.path)
        rows, size = [], 0
        for path in partition.paths:
            with fs.open_input_file(path) as file:
                for headers, payload in records(file, self.wants, self.with_payload):
                    length = headers.get("x-payload-length")
                    rows.append({c: value_of(headers, c) for c in HEADER_OF} | {"full_length": int(length) if length else None, "headers": list(headers.items()), "payload": payload, "actual_digest": base32_sha1(payload) if payload is not None else None})
                    size += 500 + len(payload or b"")
                    if size > BATCH_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, ARROW)
                        rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, ARROW)


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(self.options["path"], dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"], dict(self.options))


def register(spark: SparkSession) -> None:
    """Makes the format known to the session; sources that push filters down need the setting."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


# -- pages ------------------------------------------------------------------------------------

PAGE = "urn:page:"


def write_pages(pages: DataFrame, path: str, min_bytes: int = 0) -> None:
    """Archives ``pages`` (page_id, url, html), equal payloads of ``min_bytes`` or more as revisits."""
    register(pages.sparkSession)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload")).withColumn("digest", F.sha1("payload"))
    counts = rows.where(F.octet_length("payload") >= min_bytes).groupBy("digest").agg(F.max("page_id").alias("first"), F.count("*").alias("n"))
    with scratch(pages.sparkSession):
        # digests of several pages only; a page with many copies is dealt out to several tasks
        shared = written(counts.where("n > 1 and first is not null"), "shared")
        n = pages.count()
        hot = hot_keys(shared.select("digest", "n"), n)
        _archived(spread_join(rows, shared.drop("n"), "digest", n, "left", hot=hot)).write.format("warc").mode("append").save(path)


def _archived(rows: DataFrame) -> DataFrame:
    """The rows that the writer takes, of pages with ``first``, the page that their payload stays with."""
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    page = lambda c: F.concat(F.lit(PAGE), F.coalesce(F.col(c).cast("string"), F.lit("")))
    return rows.select(
        F.when(revisit, "revisit").otherwise("response").alias("record_type"), page("page_id").alias("record_id"), F.col("url").cast("string").alias("target_uri"),
        F.when(~revisit, F.col("payload")).alias("payload"), F.col("digest").alias("payload_digest"), F.octet_length("payload").cast("long").alias("full_length"), F.when(revisit, page("first")).alias("refers_to"),
    )


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """One row per archived page. Responses are measured on their decoded payloads; of revisits only the headers are read."""
    register(spark)
    page_id = lambda c: F.expr(f"try_cast(substring({c}, {len(PAGE) + 1}) as bigint)")
    source = lambda payload: spark.read.format("warc").option("payload", payload).load(path)
    full = source("true").where("record_type = 'response'").select("record_type", "record_id", "refers_to", F.octet_length("payload").cast("long").alias("payload_bytes"), F.col("actual_digest").alias("payload_digest"))
    heads = source("false").where("record_type = 'revisit'").select("record_type", "record_id", "refers_to", F.col("full_length").alias("payload_bytes"), F.regexp_replace("payload_digest", "^sha1:", "").alias("payload_digest"))
    return full.unionByName(heads).select(page_id("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page_id("refers_to").alias("refers_to"))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    write_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    return read_pages(spark, path)
