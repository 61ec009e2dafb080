"""WARC archives as a Spark data source (`warc`), read and written.

Writing: a task writes one archive of gzip members, a record each, whose header carries the
member's length (the `sl` field of WARC's gzip annex), and a table of offsets. Only files
of committed tasks enter the manifest, so lost tasks and retries leave no records behind.
Reading: partitions are planned from the offsets, about PART_BYTES each; predicates on the
record type and on headers are pushed down; a record's headers are inflated first, and the
payload of an unwanted record, or of any when `payload` is false, is skipped undecoded.
"""

from __future__ import annotations

import base64
import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, IsNotNull, StringStartsWith, WriterCommitMessage
from pyspark.sql.types import StructType

from cairnwatch.llm.common import cut, shared_path

PART_BYTES = 8_000_000
#: Partitions that a read is planned in at most, about; beyond, each takes several parts.
MOST_PARTS = 50_000
#: Column of the source and the header it comes from.
HEADERS = {
    "warc_type": "WARC-Type", "record_id": "WARC-Record-ID", "target_uri": "WARC-Target-URI", "warc_date": "WARC-Date",
    "payload_digest": "WARC-Payload-Digest", "refers_to": "WARC-Refers-To", "content_type": "Content-Type", "payload_length": "X-Payload-Length",
}
SCHEMA = ", ".join(f"{c} string" for c in HEADERS) + ", headers map<string,string>, payload binary"
_ARROW = pa.schema([*((c, pa.string()) for c in HEADERS), ("headers", pa.map_(pa.string(), pa.string())), ("payload", pa.binary())])


def _fs(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def encode(headers: dict[str, str], payload: bytes, level: int = 1) -> bytes:
    """One gzip member holding a record; its header tells how long the member and the record are."""
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers.items() if v is not None) + f"Content-Length: {len(payload)}\r\n\r\n"
    record = b"".join((head.encode(), payload, b"\r\n\r\n"))
    press = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = press.compress(record) + press.flush()
    total = 24 + len(body) + 8
    sizes = (total, len(record)) if max(total, len(record)) < 1 << 32 else (0, 0)  # 0: too long to tell
    return b"".join((b"\x1f\x8b\x08\x04\0\0\0\0\0\xff", struct.pack("<H2sHII", 12, b"sl", 8, *sizes), body, struct.pack("<II", zlib.crc32(record), len(record) & 0xFFFFFFFF)))


def parse_head(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    return dict(line.split(": ", 1) for line in lines[1:] if ": " in line)


def records(stream, start: int, end: int, wanted, with_payload: bool) -> Iterator[tuple[dict[str, str], bytes | None]]:
    """(headers, payload) of the members that begin in [start, end); payload is None where it isn't asked for."""
    at = start
    while at < end:
        stream.seek(at)
        fixed = stream.read(24)
        if len(fixed) < 10 or fixed[:2] != b"\x1f\x8b":
            return
        told = fixed[3] == 4 and fixed[12:14] == b"sl"
        length = struct.unpack("<I", fixed[16:20])[0] if told else 0
        # Without a length the member is read on until it ends.
        inflate = zlib.decompressobj(-15 if told else 31)
        stream.seek(at + (24 if told else 0))
        data, left = b"", b""
        while b"\r\n\r\n" not in data and not inflate.eof:
            chunk = left or stream.read(min(1024, length - 24) if length else 4096)
            if not chunk:
                break
            data += inflate.decompress(chunk, 512)
            left = inflate.unconsumed_tail
        head, _, rest = data.partition(b"\r\n\r\n")
        headers = parse_head(head)
        keep = wanted(headers)
        body = None
        if keep and with_payload or not length:
            size, parts, got = int(headers.get("Content-Length", 0)), [rest], len(rest)
            while not inflate.eof and (got < size or not length):
                chunk = left or stream.read(1 << 18)
                if not chunk:
                    break
                parts.append(inflate.decompress(chunk))
                got += len(parts[-1])
                left = b""
            body = b"".join(parts)[:size]
        if keep:
            yield headers, body if with_payload else None
        if not length:
            length = stream.tell() - at - len(inflate.unused_data) if inflate.eof else end - at
            length += 8 if told else 0
        at += length


def digest_header(sha1_hex: str) -> str:
    return "sha1:" + base64.b32encode(bytes.fromhex(sha1_hex)).decode()


@dataclass
class Committed(WriterCommitMessage):
    name: str
    offsets: list[int]


class Writer(DataSourceArrowWriter):
    def __init__(self, path: str) -> None:
        self.path = path

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        fs, root = _fs(self.path)
        fs.create_dir(root, recursive=True)
        name = f"part-{uuid.uuid4().hex}.warc.gz"
        offsets, at, begun = [], 0, 0
        with fs.open_output_stream(f"{root}/{name}", compression=None) as out:
            for batch in iterator:
                for row in batch.to_pylist():
                    headers = {h: row[c] for c, h in HEADERS.items() if row.get(c) is not None} | dict(row.get("headers") or ())
                    member = encode(headers, row.get("payload") or b"")
                    if not offsets or at - begun >= PART_BYTES:
                        offsets.append(at)
                        begun = at
                    out.write(member)
                    at += len(member)
        return Committed(name, [*offsets, at])

    def commit(self, messages: list) -> None:
        fs, root = _fs(self.path)
        fs.create_dir(root, recursive=True)
        with fs.open_output_stream(f"{root}/_manifest.json") as out:
            out.write(json.dumps({m.name: m.offsets for m in messages if m}).encode())

    def abort(self, messages: list) -> None:
        fs, root = _fs(self.path)
        for m in messages:
            if m:
                fs.delete_file(f"{root}/{m.name}")


class Span(InputPartition):
    def __init__(self, name: str, start: int, end: int) -> None:
        self.name, self.start, self.end = name, start, end


def spans(files: dict[str, list[int]], most: int = MOST_PARTS) -> list[Span]:
    """Parts of the files between their offsets, joined with those behind them where there are too many."""
    least, out = sum(o[-1] for o in files.values()) // most, []
    for name, offsets in files.items():
        begin = offsets[0]
        for end in offsets[1:]:
            if end - begin >= least or end == offsets[-1]:
                out.append(Span(name, begin, end))
                begin = end
    return out


class Reader(DataSourceReader):
    def __init__(self, path: str, payload: bool) -> None:
        self.path, self.payload, self.tests = path, payload, []

    def pushFilters(self, filters: list) -> Iterator:
        for f in filters:
            column = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            if column in HEADERS and isinstance(f, (EqualTo, In, IsNotNull, StringStartsWith)):
                self.tests.append(f)
            else:
                yield f

    def wanted(self, headers: dict[str, str]) -> bool:
        for f in self.tests:
            value = headers.get(HEADERS[f.attribute[0]])
            ok = value is not None and (isinstance(f, IsNotNull) or isinstance(f, EqualTo) and value == f.value or isinstance(f, In) and value in f.value or isinstance(f, StringStartsWith) and value.startswith(f.value))
            if not ok:
                return False
        return True

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs as pfs

        fs, root = _fs(self.path)
        if fs.get_file_info(f"{root}/_manifest.json").is_file:
            with fs.open_input_file(f"{root}/_manifest.json") as f:
                files = json.loads(f.read())
            return spans(files) or [Span("", 0, 0)]
        found = fs.get_file_info(pfs.FileSelector(root, recursive=True))
        return [Span(f.path.removeprefix(f"{root}/"), 0, f.size) for f in found if f.path.endswith(".warc.gz")] or [Span("", 0, 0)]

    def read(self, span: InputPartition) -> Iterator[pa.RecordBatch]:
        if not span.name:
            return
        fs, root = _fs(self.path)
        rows, size = [], 0
        with fs.open_input_file(f"{root}/{span.name}") as stream:
            for headers, payload in records(stream, span.start, span.end, self.wanted, self.payload):
                rows.append({c: headers.get(h) for c, h in HEADERS.items()} | {"headers": list(headers.items()), "payload": payload})
                size += len(payload or b"") + 500
                if size > 2_000_000:
                    yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)
                    rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)


class WarcSource(DataSource):
    """Options: path, and payload (`false`: headers alone)."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> Reader:
        return Reader(self.options["path"], self.options.get("payload", "true").lower() != "false")

    def writer(self, schema: StructType, overwrite: bool) -> Writer:
        return Writer(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def to_records(pages: DataFrame, least_bytes: int = 1000) -> DataFrame:
    """Rows for the writer: of equal payloads of least_bytes or more, the largest page_id's is the response.

    A null html is an empty payload; a null page_id is smaller than any; rows that repeat
    page_id and payload are all responses. The groups' largest ids are pre-aggregated, and
    the join back reads a written table, so that AQE can split a hot payload.
    """
    rows = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].cast("string").alias("url"), F.coalesce(pages["html"].cast("string"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("sha1", F.sha1("payload"))
    long_ = F.octet_length("payload") >= least_bytes
    groups = rows.where(long_).groupBy("sha1").agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("sha1", "first")
    joined = rows.join(cut(groups, "warc-groups"), "sha1", "left")
    revisit = F.coalesce(F.col("first") != F.coalesce("page_id", F.lit(-(1 << 63))), F.lit(False))
    urn = lambda c: F.concat(F.lit("urn:page:"), F.coalesce(c.cast("string"), F.lit("null")))
    return joined.select(
        F.when(revisit, "revisit").otherwise("response").alias("warc_type"),
        urn(F.col("page_id")).alias("record_id"),
        F.regexp_replace("url", r"[\r\n]", "").alias("target_uri"),
        F.lit("2024-01-01T00:00:00Z").alias("warc_date"),
        F.concat(F.lit("sha1:"), F.col("sha1")).alias("payload_digest"),
        F.when(revisit, urn(F.col("first"))).alias("refers_to"),
        F.lit("text/html; charset=utf-8").alias("content_type"),
        F.octet_length("payload").cast("string").alias("payload_length"),
        F.when(~revisit, F.col("payload")).alias("payload"),
    )


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes pages as archives in the shared folder, reads them back: a row for each page.

    Responses are decoded and digested anew; revisits are read by their headers alone. Null
    and empty payloads are responses of no bytes, long ones are written whole, rows that
    repeat each have their record, a null page_id stays null; an empty table gives an empty
    result, and columns beyond page_id, url and html are not read.
    """
    spark = pages.sparkSession
    register(spark)
    path = shared_path(spark, "warc")
    to_records(pages).write.format("warc").mode("append").save(path)
    ident = lambda c: F.substring(F.col(c), 10, 30).try_cast("long")  # noqa: E731  after urn:page:
    responses = spark.read.format("warc").load(path).where("warc_type = 'response'").select(
        ident("record_id").alias("page_id"), F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("payload_digest"), "warc_type", F.lit(None).cast("long").alias("refers_to"), "target_uri")
    revisits = spark.read.format("warc").option("payload", "false").load(path).where("warc_type = 'revisit'").select(
        ident("record_id").alias("page_id"), F.col("payload_length").cast("long").alias("payload_bytes"), F.substring_index("payload_digest", ":", -1).alias("payload_digest"), "warc_type", ident("refers_to").alias("refers_to"), "target_uri")
    return responses.unionByName(revisits)
