"""WARC archives as a Spark data source, and pages written as deduplicated records.

``spark.read.format("warc")`` plans one partition for a group of files, takes
the predicates on record type, record id, target and digest into the scan,
reads the header of a record first and jumps over the bodies nobody asked
for.  Members of ``.warc.gz`` files are jumped over by the skip-length field
(``sl``) where the writer left one, and inflated without being kept elsewhere.

A write is committed by a manifest of the files of successful attempts, so
what a lost or repeated task leaves behind is never read.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    Filter,
    In,
    InputPartition,
    StringStartsWith,
    WriterCommitMessage,
)
from pyspark.sql.pandas.types import from_arrow_schema

from tillwise.scratch import new_path

MANIFEST = "_manifest.json"
DIGEST = "sha1:"
PAGE = "urn:x-page:"

RECORD = pa.schema(
    [
        ("record_type", pa.string()),
        ("record_id", pa.string()),
        ("target_uri", pa.string()),
        ("date", pa.string()),
        ("refers_to", pa.string()),
        ("payload_digest", pa.string()),
        ("content_length", pa.int64()),
        ("http_length", pa.int64()),
        ("payload", pa.binary()),
    ]
)
SCHEMA = from_arrow_schema(RECORD)
HEADER = {
    "WARC-Type": "record_type",
    "WARC-Record-ID": "record_id",
    "WARC-Target-URI": "target_uri",
    "WARC-Date": "date",
    "WARC-Refers-To": "refers_to",
    "WARC-Payload-Digest": "payload_digest",
}
BY_NAME = {k.lower(): v for k, v in HEADER.items()}
BATCH_BYTES = 8 << 20


@dataclass
class Files(InputPartition):
    paths: list[str]


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


class WarcSource(DataSource):
    """Options: ``payloads`` (default true; false leaves all bodies unread),
    ``partition_bytes`` (files are grouped up to this size, default 128 MB),
    ``file_bytes`` (a file is closed at this size, default 1 GB)."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options)

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options)


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _uri(path: str) -> str:
    return "file://" + path.removeprefix("file:") if path.startswith("file:/") and not path.startswith("file://") else path


class WarcReader(DataSourceReader):
    def __init__(self, options) -> None:
        self.path = _uri(options["path"])
        self.payloads = options.get("payloads", "true").lower() == "true"
        self.partition_bytes = int(options.get("partition_bytes", 128 << 20))
        self.tests: list[tuple[str, str, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes equality, IN and prefix tests on header columns; the rest stays with Spark."""
        headers = set(HEADER.values())
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if column not in headers:
                yield f
            elif isinstance(f, EqualTo):
                self.tests.append((column, "in", {f.value}))
            elif isinstance(f, In):
                self.tests.append((column, "in", set(f.value)))
            elif isinstance(f, StringStartsWith):
                self.tests.append((column, "prefix", f.value))
            else:
                yield f

    def wanted(self, header: dict[str, object]) -> bool:
        return all(
            header[c] is not None and (header[c] in v if how == "in" else header[c].startswith(v))
            for c, how, v in self.tests
        )

    def partitions(self) -> Sequence[InputPartition]:
        where, base = _open(self.path)
        groups: list[list[str]] = []
        room = 0
        infos = [i for i in where.get_file_info(list(_listed(where, base))) if i.type == fs.FileType.File]
        for info in sorted(infos, key=lambda i: i.path):
            if not groups or info.size > room:
                groups.append([])
                room = self.partition_bytes
            groups[-1].append(info.path)
            room -= info.size
        return [Files(g) for g in groups] or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        where, _ = _open(self.path)
        rows: list[dict[str, object]] = []
        held = 0
        for path in partition.paths:
            for row in records(where, path, self.wanted, self.payloads):
                rows.append(row)
                held += 300 + len(row["payload"] or b"")
                if held >= BATCH_BYTES:
                    yield pa.RecordBatch.from_pylist(rows, RECORD)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, RECORD)


def _listed(where: fs.FileSystem, base: str) -> Iterator[str]:
    """Committed files of a written folder; else all archives below the path, or the file itself."""
    kind = where.get_file_info(base).type
    if kind == fs.FileType.File:
        yield base
        return
    manifests = [
        i.path for i in where.get_file_info(fs.FileSelector(base)) if i.base_name.endswith(MANIFEST)
    ]
    if manifests:
        for m in manifests:
            with where.open_input_stream(m) as f:
                for name in json.loads(f.read()):
                    yield f"{base}/{name}"
        return
    for i in where.get_file_info(fs.FileSelector(base, recursive=True)):
        if i.base_name.endswith((".warc", ".warc.gz")):
            yield i.path


def records(where: fs.FileSystem, path: str, wanted, payloads: bool) -> Iterator[dict[str, object]]:
    """The wanted records of one file."""
    with where.open_input_file(path) as f:
        size = f.size()
        at = 0
        zipped = f.read_at(2, 0) == b"\x1f\x8b"
        buffered = _Window(f, size)
        while at < size:
            if zipped:
                at = yield from _member(buffered, at, wanted, payloads)
                continue
            row, at = _plain(buffered, at, wanted, payloads)
            if row is not None:
                yield row


class _Window:
    """Forward reads with a buffer; what is jumped over is not read."""

    def __init__(self, f, size: int, step: int = 1 << 20) -> None:
        self.f, self.size, self.step, self.start, self.data = f, size, step, 0, b""

    def get(self, at: int, n: int) -> bytes:
        n = min(n, self.size - at)
        if not (self.start <= at and at + n <= self.start + len(self.data)):
            self.start, self.data = at, self.f.read_at(max(n, min(self.step, self.size - at)), at)
        return self.data[at - self.start : at - self.start + n]


def _header(block: bytes) -> dict[str, object]:
    row: dict[str, object] = dict.fromkeys(RECORD.names)
    for line in block.decode("utf-8", "replace").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        value = value.strip()
        if (column := BY_NAME.get(name.lower())) is not None:
            row[column] = value.removeprefix("<").removesuffix(">") if column in ("record_id", "refers_to") else value
        elif name.lower() == "content-length":
            row["content_length"] = int(value)
    return row


def _body(row: dict[str, object], body: bytes, payloads: bool) -> dict[str, object]:
    """Splits an HTTP message; other blocks are the payload themselves."""
    head, sep, rest = body.partition(b"\r\n\r\n")
    if body.startswith(b"HTTP/") and sep:
        for line in head.split(b"\r\n")[1:]:
            name, _, value = line.partition(b":")
            if name.lower() == b"content-length":
                row["http_length"] = int(value)
    else:
        rest = body
    if payloads and row["record_type"] != "revisit":
        row["payload"] = rest
    return row


def _plain(f: _Window, at: int, wanted, payloads: bool):
    n = 4096
    while (end := (block := f.get(at, n)).find(b"\r\n\r\n")) < 0:
        if at + n >= f.size:
            if block.strip():
                raise ValueError(f"no WARC header at byte {at}")
            return None, f.size
        n *= 4
    row = _header(block[:end])
    start, length = at + end + 4, row["content_length"] or 0
    if wanted(row):
        row = _body(row, f.get(start, length if payloads else min(length, 4096)), payloads)
    else:
        row = None
    return row, start + length + 4


def _member(f: _Window, at: int, wanted, payloads: bool):
    """The wanted records of a gzip member, inflated a piece at a time; returns where the next member begins."""
    jump = unpacked = None
    if f.get(at, 16)[3] & 4:
        extra = f.get(at + 12, 12)
        if extra[:2] == b"sl":
            packed, unpacked = struct.unpack("<II", extra[4:12])
            jump = at + packed
    inflate = zlib.decompressobj(31)
    out, pos, n = bytearray(), at, 4096

    def more() -> bool:
        nonlocal pos, n
        if inflate.eof:
            return False
        raw = inflate.unconsumed_tail
        if not raw:
            raw = f.get(pos, n)
            if not raw:
                raise ValueError(f"cut member at byte {at}")
            pos += len(raw)
            n = 64 << 10
        out.extend(inflate.decompress(raw, 1 << 20))
        return True

    first = True
    while True:
        while True:
            blank = 0
            while blank < len(out) and out[blank] in b"\r\n":
                blank += 1
            del out[:blank]
            if out or not more():
                break
        while (end := out.find(b"\r\n\r\n")) < 0 and more():
            pass
        if end < 0:
            if out.strip():
                raise ValueError(f"no WARC header in the member at byte {at}")
            return pos - len(inflate.unused_data)
        row = _header(bytes(out[:end]))
        keep, length = wanted(row), row["content_length"] or 0
        # Only a member that is this record alone may be left by the length it gives.
        leave = first and jump and unpacked == (end + 4 + length + 4) & 0xFFFFFFFF and not (keep and payloads)
        first = False
        del out[: end + 4]
        if keep:
            need = min(length, 4096) if leave else length
            while len(out) < need and more():
                pass
            yield _body(row, bytes(out[:need]), payloads)
        if leave:
            return jump
        while length > len(out):
            length -= len(out)
            out.clear()
            if not more():
                break
        del out[:length]


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options) -> None:
        self.path = _uri(options["path"])
        self.file_bytes = int(options.get("file_bytes", 1 << 30))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        """Each file gets a new name, so repeated attempts never meet."""
        where, base = _open(self.path)
        where.create_dir(base, recursive=True)
        files: list[str] = []
        out, held = None, 0
        try:
            for batch in iterator:
                columns = [batch.column(n) for n in RECORD.names]
                for i in range(batch.num_rows):
                    if out is None or held >= self.file_bytes:
                        if out is not None:
                            out.close()
                        files.append(f"{uuid.uuid4().hex}.warc.gz")
                        out, held = where.open_output_stream(f"{base}/{files[-1]}", compression=None), 0
                    member = gzip_member(record(dict(zip(RECORD.names, (c[i].as_py() for c in columns), strict=True))))
                    out.write(member)
                    held += len(member)
        finally:
            if out is not None:
                out.close()
        return Written(files)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        where, base = _open(self.path)
        where.create_dir(base, recursive=True)
        with where.open_output_stream(f"{base}/{uuid.uuid4().hex}{MANIFEST}") as f:
            f.write(json.dumps([n for m in messages if m for n in m.files]).encode())

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        where, base = _open(self.path)
        for m in messages:
            for n in m.files if m else []:
                where.delete_file(f"{base}/{n}")


def record(row: dict[str, object]) -> bytes:
    """One record; the block is an HTTP message, without its body for a revisit."""
    payload = row["payload"] or b""
    length = row["http_length"] if row["http_length"] is not None else len(payload)
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    if row["record_type"] != "revisit":
        block += payload
    lines = ["WARC/1.1"]
    for name, column in HEADER.items():
        if (value := row[column]) is not None:
            value = " ".join(str(value).split())
            lines.append(f"{name}: <{value}>" if column in ("record_id", "refers_to") else f"{name}: {value}")
    if row["record_type"] == "revisit":
        lines.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def gzip_member(data: bytes) -> bytes:
    """A gzip member whose extra field ``sl`` holds its packed and unpacked length."""
    deflate = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = deflate.compress(data) + deflate.flush()
    total = 10 + 2 + 12 + len(body) + 8
    extra = b"sl" + struct.pack("<HII", 8, total, len(data) & 0xFFFFFFFF)
    tail = struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", len(extra)) + extra + body + tail


def register(spark: SparkSession) -> None:
    """Make the format known to the session and let predicates reach it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 SHA-1 of a binary column: 20 bits of the hex form at a time."""
    letters = F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
    hex40 = F.sha1(payload)
    out = []
    for i in range(8):
        bits = F.conv(F.substring(hex40, 5 * i + 1, 5), 16, 10).cast("int")
        for shift in (15, 10, 5, 0):
            out.append(letters.substr(F.shiftright(bits, shift).bitwiseAND(31) + 1, F.lit(1)))
    return F.concat(*out)


def page_records(
    pages: DataFrame,
    smallest: int = 0,
    page_id: str = "page_id",
    url: str = "url",
    html: str = "html",
    date: str = "1970-01-01T00:00:00Z",
) -> DataFrame:
    """One record for each page, payloads in UTF-8 (null: empty).

    Of the records with equal payloads of at least ``smallest`` bytes that
    with the smallest page id is a response and the others revisit it.  Pages
    without an id are responses and are never revisited; repeated rows of the
    smallest id are all responses.  Other columns are not read.
    """
    rows = pages.select(
        F.col(page_id).alias("_page"),
        F.col(url).cast("string").alias("target_uri"),
        F.coalesce(F.col(html).cast("binary"), F.lit("").cast("binary")).alias("payload"),
    ).withColumn("_digest", base32_sha1(F.col("payload")))
    long_enough = F.octet_length("payload") >= smallest
    copies = (
        rows.where(long_enough & F.col("_page").isNotNull())
        .groupBy("_digest")
        .agg(F.min("_page").alias("_first"), F.count(F.lit(1)).alias("_n"))
        .where("_n > 1")
        .select("_digest", "_first")
    )
    joined = rows.join(copies, "_digest", "left")
    revisit = long_enough & (F.col("_page") > F.col("_first"))
    return joined.select(
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.concat(F.lit(PAGE), F.coalesce(F.col("_page").cast("string"), F.lit(""))).alias("record_id"),
        "target_uri",
        F.lit(date).alias("date"),
        F.when(revisit, F.concat(F.lit(PAGE), F.col("_first").cast("string"))).alias("refers_to"),
        F.concat(F.lit(DIGEST), "_digest").alias("payload_digest"),
        F.lit(None).cast("bigint").alias("content_length"),
        F.octet_length("payload").cast("bigint").alias("http_length"),
        F.when(~F.coalesce(revisit, F.lit(False)), F.col("payload")).alias("payload"),
    )


def write(rows: DataFrame, path: str) -> str:
    """Write records below ``path``; every task closes its files at 1 GB."""
    register(rows.sparkSession)
    rows.write.format("warc").mode("append").save(path)
    return path


def read(spark: SparkSession, path: str, payloads: bool = True, where: Column | str | None = None) -> DataFrame:
    """Records below ``path``; ``where`` on header columns is taken into the scan.

    Spark 4.1 keeps the predicates a loaded source was first run with, also
    for later queries on the same frame.  So predicates are given here, with
    a load of their own; later filters see columns that are expressions and
    stay with Spark.
    """
    register(spark)
    rows = spark.read.format("warc").option("payloads", str(payloads).lower()).load(path)
    if where is not None:
        rows = rows.where(where)
    headers = set(HEADER.values())
    return rows.select(*[F.concat(F.col(c), F.lit("")).alias(c) if c in headers else F.col(c) for c in rows.columns])


def page_id_of(record_id: Column) -> Column:
    """The page id in a record id; null where the page has none."""
    return F.try_to_number(F.regexp_extract(record_id, r"^urn:x-page:(-?\d+)$", 1), F.lit("S9999999999999999999")).cast(
        "bigint"
    )


def archive(pages: DataFrame, smallest: int = 0) -> DataFrame:
    """Write the pages to an archive in the shared folder, read it back, and tell what each record holds.

    Lengths and digests of responses are computed from the payload read back,
    those of revisits come from their headers.
    """
    spark = pages.sparkSession
    path = write(page_records(pages, smallest), new_path(spark, "warc"))
    kept = read(spark, path, where="record_type = 'response'").unionAll(
        read(spark, path, payloads=False, where="record_type = 'revisit'")
    )
    response = F.col("record_type") == "response"
    return kept.select(
        page_id_of(F.col("record_id")).alias("page_id"),
        F.when(response, F.octet_length("payload")).otherwise(F.col("http_length")).cast("bigint").alias("payload_bytes"),
        F.when(response, base32_sha1(F.col("payload")))
        .otherwise(F.expr(f"substr(payload_digest, {len(DIGEST) + 1})"))
        .alias("payload_digest"),
        "record_type",
        page_id_of(F.col("refers_to")).alias("refers_to"),
    )
