"""Operator 2, WARC: a Python data source that writes and reads WARC 1.1 archives.

Write: `df.write.format("warc").mode("append").save(folder)` makes one file for each task and
`roll_bytes` (option; 128 MB by default), gzipped a record at a time (option `compression`: gzip or
none). Task attempts use names of their own; a manifest written on commit names the files that count,
so what a lost executor left behind is never read. Each gzip member carries its length in an extra
field (SL), so that a reader can step over it.

Read: `spark.read.format("warc").load(path)`, a file, a folder or several joined by commas. Files are
planned into partitions of about `partition_bytes`. Filters on record type, record id, target URI,
digest and refers-to are pushed down (spark.sql.python.filterPushdown.enabled; `register` sets it):
a record's headers are parsed first, from the first bytes inflated, and an unwanted record is stepped
over without inflating or decoding its payload. Options: `payload` (false: column left null),
`verify` (true: the payload's SHA-1 is compared with its header).

Defined cases: a null payload is empty. Records whose payload is smaller than `least_bytes` are all
responses. Repeated ids with equal payload: each row that has the smallest id is a response. A null
id can be no one's referent: such a row is a response unless its payload has a smaller, real id.
Without rows an empty archive (manifest only) is written and read as no rows. Blanks and control
characters of a URI are written percent-encoded (and compared so by filters); a null URI has no header
and is read back as null.
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
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, StringStartsWith, WriterCommitMessage

SCHEMA = (
    "record_id string, record_type string, target_uri string, date string, payload_digest string, refers_to string, "
    "payload_bytes long, payload binary, file string, offset long"
)
#: Header of each pushed-down column.
HEADER = {"record_id": "warc-record-id", "record_type": "warc-type", "target_uri": "warc-target-uri", "payload_digest": "warc-payload-digest", "refers_to": "warc-refers-to"}
MANIFEST = "_manifest.json"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BLOCK = 1 << 20
ROWS = 512


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if m := re.match(r"file:/*(/.*)", path):
        path = m[1]
    return (pafs.LocalFileSystem(), path) if path.startswith("/") else pafs.FileSystem.from_uri(path)


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def header_uri(uri: str) -> str:
    """The URI with blanks and control characters percent-encoded, so that it can't end its header line."""
    return re.sub(r"[\s\x00-\x1f\x7f]", lambda m: quote(m[0]), uri)


def record_bytes(record_id: str, record_type: str, uri: str | None, date: str, digest: str, refers_to: str | None, payload: bytes) -> bytes:
    """One record. A revisit keeps the HTTP head and states the length of the payload that it leaves out."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if record_type == "revisit" else head + payload
    lines = ["WARC/1.1", f"WARC-Type: {record_type}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {date}", *([] if uri is None else [f"WARC-Target-URI: {header_uri(uri)}"]), f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {len(payload)}"]
    if record_type == "revisit":
        lines += [f"WARC-Refers-To: <{refers_to}>", f"WARC-Profile: {PROFILE}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int = 3) -> bytes:
    """A gzip member with its own length in the extra field SL."""
    packer = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = packer.compress(data) + packer.flush()
    size = 10 + 2 + 8 + len(body) + 8
    return b"\x1f\x8b\x08\x04\x00\x00\x00\x00\x00\x03" + struct.pack("<H2sHI", 8, b"SL", 4, size) + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


class Input:
    """A file read in blocks, with looking ahead and stepping over."""

    def __init__(self, file: pa.NativeFile):
        self.file, self.size, self.at, self.base, self.block = file, file.size(), 0, 0, b""

    def peek(self, n: int) -> bytes:
        if self.at + n > self.base + len(self.block) or self.at < self.base:
            self.file.seek(min(self.at, self.size))
            self.base, self.block = self.at, self.file.read(max(n, BLOCK))
        return self.block[self.at - self.base : self.at - self.base + n]

    def take(self, n: int) -> bytes:
        out = self.peek(n)
        self.at += len(out)
        return out


def parse_head(data: bytes) -> dict[str, str]:
    fields, name = {}, ""
    for line in data.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and name:
            fields[name] += " " + line.strip()
        elif ":" in line:
            name, _, value = line.partition(":")
            name = name.strip().lower()
            fields[name] = value.strip()
    return fields


def records(source: Input, wanted) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, headers, block) of the records whose headers are wanted; the others' blocks aren't inflated where that can be avoided."""
    while source.at < source.size:
        start = source.at
        if source.peek(2) == b"\x1f\x8b":
            yield from gzipped(source, start, wanted)
        elif source.peek(5) == b"WARC/":
            n = 4096
            while (end := source.peek(n).find(b"\r\n\r\n")) < 0:
                if n > source.size:
                    raise ValueError(f"no end of headers at {start}")
                n *= 4
            head = parse_head(source.take(end + 4)[:end])
            length = int(head.get("content-length", 0))
            if wanted(head):
                yield start, head, source.take(length)
            else:
                source.at += length
            source.at += 4
        elif source.peek(1) in (b"\r", b"\n"):
            source.at += 1
        else:
            raise ValueError(f"no WARC record at {start}")


def gzipped(source: Input, start: int, wanted) -> Iterator[tuple[int, dict[str, str], bytes]]:
    flags, size, skip = source.peek(4)[3], 0, 10
    if flags & 4:
        extra = source.peek(12 + struct.unpack("<H", source.peek(12)[10:])[0])[12:]
        skip += 2 + len(extra)
        while len(extra) >= 4:
            tag, n = struct.unpack("<2sH", extra[:4])
            if tag == b"SL" and n == 4:
                size = struct.unpack("<I", extra[4:8])[0]
            extra = extra[4 + n :]
    for bit in (8, 16):  # file name, comment
        if flags & bit:
            while source.peek(skip + 1)[skip:] != b"\0":
                skip += 1
            skip += 1
    skip += 2 * bool(flags & 2)
    source.at += skip
    inflate, data = zlib.decompressobj(-15), b""
    while (end := data.find(b"\r\n\r\n")) < 0 and not inflate.eof:
        fed = inflate.unconsumed_tail or source.take(4096)
        if not fed:
            raise ValueError(f"gzip member at {start} breaks off")
        data += inflate.decompress(fed, 4096)
    head = parse_head(data[:end])
    take = wanted(head)
    if take or not size:
        parts = [data]
        while not inflate.eof:
            fed = inflate.unconsumed_tail or source.take(1 << 16)
            if not fed:
                raise ValueError(f"gzip member at {start} breaks off")
            parts.append(inflate.decompress(fed))
            if not take:
                parts.clear()
        source.at = start + size if size else source.at - len(inflate.unused_data) + 8
        if take:
            block = b"".join(parts)[end + 4 :]
            yield start, head, block[: int(head.get("content-length", len(block)))]
    else:
        source.at = start + size


@dataclass
class Files(InputPartition):
    files: tuple[str, ...]


class WarcReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.payload = options.get("payload", "true").lower() == "true"
        self.verify = options.get("verify", "false").lower() == "true"
        self.target = int(options.get("partition_bytes", 32 << 20))
        self.tests: list[tuple[str, str, tuple]] = []

    def pushFilters(self, filters):
        for f in filters:
            name = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            if name in HEADER and isinstance(f, EqualTo | In):
                self.tests.append((name, "in", tuple(f.value) if isinstance(f, In) else (f.value,)))
            elif name in HEADER and isinstance(f, StringStartsWith):
                self.tests.append((name, "starts", (f.value,)))
            else:
                yield f

    def wanted(self, head: dict[str, str]) -> bool:
        for name, kind, values in self.tests:
            value = head.get(HEADER[name])
            value = value if name == "target_uri" else bare(value)
            if value is None or not (value in values if kind == "in" else value.startswith(values)):
                return False
        return True

    def partitions(self) -> list[Files]:
        """Files packed, largest first, so that each partition has about `target` bytes."""
        found: list[tuple[int, str]] = []
        for part in self.path.split(","):
            fs, at = filesystem(part)
            info = fs.get_file_info(at)
            if info.type == pafs.FileType.File:
                found.append((info.size, part))
                continue
            listed = {x.base_name: x.size for x in fs.get_file_info(pafs.FileSelector(at))}
            manifests = [x for x in listed if x.endswith(MANIFEST)]
            names = [n for x in manifests for n in json.loads(fs.open_input_file(f"{at}/{x}").read())] if manifests else [x for x in listed if re.search(r"\.warc(\.gz)?$", x)]
            found += [(listed[x], f"{part.rstrip('/')}/{x}") for x in names]
        packs: list[tuple[int, list[str]]] = []
        for size, file in sorted(found, reverse=True):
            if packs and packs[-1][0] + size <= self.target:
                packs[-1] = (packs[-1][0] + size, [*packs[-1][1], file])
            else:
                packs.append((size, [file]))
        return [Files(tuple(files)) for _, files in packs] or [Files(())]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for file in partition.files:
            fs, at = filesystem(file)
            with fs.open_input_file(at) as f:
                for offset, head, block in records(Input(f), self.wanted):
                    row = self.row(file, offset, head, block)
                    rows.append(row)
                    held += len(row[7] or b"")
                    if len(rows) >= ROWS or held > 8 << 20:
                        yield batch(rows)
                        rows, held = [], 0
        if rows:
            yield batch(rows)

    def row(self, file: str, offset: int, head: dict[str, str], block: bytes) -> tuple:
        digest, kind = bare(head.get("warc-payload-digest")), head.get("warc-type")
        length = int(head["x-payload-length"]) if "x-payload-length" in head else None
        payload = None
        if kind != "revisit" and (self.payload or self.verify or length is None):
            payload = block.partition(b"\r\n\r\n")[2] if "http" in head.get("content-type", "") else block
            if self.verify and digest and base32_sha1(payload) != digest:
                raise ValueError(f"{file} at {offset}: the payload's digest isn't {digest}")
            length = len(payload)
        return (bare(head.get("warc-record-id")), kind, head.get("warc-target-uri"), head.get("warc-date"), digest, bare(head.get("warc-refers-to")), length, payload if self.payload else None, file, offset)


def bare(value: str | None) -> str | None:
    return value and value.removeprefix("<").removesuffix(">").removeprefix("sha1:")


def batch(rows: list[tuple]) -> pa.RecordBatch:
    s, n = pa.string(), pa.int64()
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (s, s, s, s, s, s, n, pa.binary(), s, n), strict=True)], names=[x.split()[0] for x in SCHEMA.split(", ")])


@dataclass
class Written(WriterCommitMessage):
    files: tuple[str, ...]


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str], overwrite: bool):
        self.path, self.overwrite = options["path"].rstrip("/"), overwrite
        self.roll = int(options.get("roll_bytes", 128 << 20))
        self.gzip = options.get("compression", "gzip") == "gzip"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, at = filesystem(self.path)
        fs.create_dir(at, recursive=True)
        files: list[str] = []
        out = None
        for b in iterator:
            for r in b.to_pylist():
                if out is None or out.tell() >= self.roll:
                    if out is not None:
                        out.close()
                    files.append(f"{uuid.uuid4().hex}.warc" + ".gz" * self.gzip)
                    out = fs.open_output_stream(f"{at}/{files[-1]}", compression=None)
                data = record_bytes(r["record_id"] or "", r["record_type"], r["target_uri"], r["date"], r["payload_digest"], r["refers_to"], r["payload"] or b"")
                out.write(member(data) if self.gzip else data)
        if out is not None:
            out.close()
        return Written(tuple(files))

    def commit(self, messages: list[Written | None]) -> None:
        fs, at = filesystem(self.path)
        fs.create_dir(at, recursive=True)
        if self.overwrite:
            for x in fs.get_file_info(pafs.FileSelector(at)):
                if x.base_name.endswith(MANIFEST):
                    fs.delete_file(x.path)
        with fs.open_output_stream(f"{at}/{uuid.uuid4().hex}{MANIFEST}", compression=None) as f:
            f.write(json.dumps([x for m in messages if m for x in m.files]).encode())

    def abort(self, messages: list[Written | None]) -> None:
        fs, at = filesystem(self.path)
        for x in (x for m in messages if m for x in m.files):
            fs.delete_file(f"{at}/{x}")


class WarcDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options)

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WarcDataSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def plan_records(pages: DataFrame, key: str = "page_id", uri: str = "url", payload: str = "html", least_bytes: int = 0, date: str = "2000-01-01T00:00:00Z") -> DataFrame:
    """The records to write. Ids are urn:page:<key>.

    The payload crosses the network once, with its digest as the key; only (digest, smallest key) is
    joined to it. A digest that a third of the pages share is split by AQE's skew join.
    """
    body = pages.select(F.col(key).alias("_id"), F.col(uri).alias("target_uri"), F.encode(F.coalesce(F.col(payload), F.lit("")), "utf-8").alias("payload"))
    body = body.withColumn("_sha", F.sha1("payload")).withColumn("_size", F.octet_length("payload"))
    first = body.filter(F.col("_size") >= least_bytes).groupBy("_sha").agg(F.min("_id").alias("_first"))
    joined = body.join(first.withColumnRenamed("_sha", "_key"), (F.col("_sha") == F.col("_key")) & (F.col("_size") >= least_bytes), "left")
    again = F.coalesce(F.col("_first") != F.col("_id"), F.col("_first").isNotNull())
    urn = lambda c: F.concat(F.lit("urn:page:"), F.coalesce(c.cast("string"), F.lit("")))
    return joined.select(
        urn(F.col("_id")).alias("record_id"),
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        "target_uri",
        F.lit(date).alias("date"),
        base32(F.col("_sha")).alias("payload_digest"),
        F.when(again, urn(F.col("_first"))).alias("refers_to"),
        "payload",
    )


def base32(hex40):
    """Base32 of a 40-digit hexadecimal column: 5 digits (20 bits) make 4 letters."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    groups = [F.conv(F.substring(hex40, 1 + 5 * g, 5), 16, 10).cast("int") for g in range(8)]
    return F.concat(*[F.substring(F.lit(letters), F.shiftright(g, s).bitwiseAND(31) + 1, F.lit(1)) for g in groups for s in (15, 10, 5, 0)])
