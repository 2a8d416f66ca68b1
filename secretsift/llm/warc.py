"""WARC archives: a Python data source that writes and reads them, and archives of pages.

Writing puts one gzip member per record. Each member states its own length in the
``sl`` extra field, so a reader that has parsed a record's headers and does not
want it goes on to the next without decoding the rest. Files of other writers are
read too, compressed or not; where a member has no ``sl`` field its rest is
decoded and thrown away.

Reading plans one partition per archive file. Predicates on header columns are
evaluated on the headers, before a payload is decoded; ``payload=false`` decodes
none. Files may lie in any store that Arrow reads.

Only files that a finished job has named in its manifest are read, so what lost
or repeated tasks left behind does not count. Records with malformed headers end
their file with an error.
"""

from __future__ import annotations

import gzip
import json
import struct
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull,
    StringStartsWith, WriterCommitMessage,
)
from pyspark.sql.types import StructType

from secretsift.llm.common import store_of, whole
from secretsift.session import new_work_path

SCHEMA = ("record_type string, record_id string, target_uri string, date string, refers_to string, "
          "payload_digest string, payload_bytes long, payload binary")
# Column of a record and the header that holds it.
HEADERS = {
    "record_type": "WARC-Type", "record_id": "WARC-Record-ID", "target_uri": "WARC-Target-URI",
    "date": "WARC-Date", "refers_to": "WARC-Refers-To", "payload_digest": "WARC-Payload-Digest",
    "payload_bytes": "X-Payload-Length",
}
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "_MANIFEST"
MAX_FILE_BYTES = 1 << 30
MIN_REVISIT_BYTES = 100
_END, _CHUNK, _BATCH_BYTES = b"\r\n\r\n", 1 << 14, 8 << 20
_DATE = "1970-01-01T00:00:00Z"


# Writing

def _member(record: bytes) -> bytes:
    """A gzip member that names its own length."""
    packer = zlib.compressobj(1, zlib.DEFLATED, -15)
    body = packer.compress(record) + packer.flush()
    size = 10 + 2 + 12 + len(body) + 8
    extra = b"sl" + struct.pack("<HII", 8, size, len(record) & 0xFFFFFFFF)
    head = b"\x1f\x8b\x08\x04" + bytes(4) + b"\x00\xff" + struct.pack("<H", len(extra)) + extra
    return head + body + struct.pack("<II", zlib.crc32(record), len(record) & 0xFFFFFFFF)


def _clean(value: str) -> str:
    """A header value on one line: control characters are written as in a URL."""
    return "".join(f"%{ord(c):02X}" if c < " " or c == "\x7f" else c for c in value) if not value.isprintable() else value


def record_bytes(row: dict) -> bytes:
    """One record, uncompressed, from a row of ``SCHEMA``."""
    payload = row["payload"] or b""
    if row["record_type"] == "response":
        content = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(
            payload) + payload
        extra = ["Content-Type: application/http; msgtype=response"]
    else:
        content = payload
        extra = [f"WARC-Profile: {SAME_PAYLOAD}"] if row["record_type"] == "revisit" else []
    lines = ["WARC/1.1"]
    for column, name in HEADERS.items():
        value = row[column]
        if column == "payload_digest" and value is not None:
            value = f"sha256:{value}"
        if value is not None:
            lines.append(f"{name}: {_clean(str(value))}")
    lines += [*extra, f"Content-Length: {len(content)}"]
    return "\r\n".join(lines).encode() + _END + content + _END


@dataclass
class _Written(WriterCommitMessage):
    files: list[str]


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, path: str) -> None:
        self.path = path

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        store, folder = store_of(self.path)
        store.create_dir(folder, recursive=True)
        task, names, out = TaskContext.get().partitionId(), [], None
        try:
            for batch in iterator:
                for row in _rows(batch):
                    if out is None or out.tell() >= MAX_FILE_BYTES:
                        if out is not None:
                            out.close()
                        names.append(f"{task:05d}-{uuid.uuid4().hex}.warc.gz")
                        out = store.open_output_stream(f"{folder}/{names[-1]}", compression=None, buffer_size=1 << 20)
                    out.write(_member(record_bytes(row)))
        finally:
            if out is not None:
                out.close()
        return _Written(names)

    def commit(self, messages: list[_Written]) -> None:
        store, folder = store_of(self.path)
        store.create_dir(folder, recursive=True)
        names = sorted(n for m in messages if m for n in m.files)
        with store.open_output_stream(f"{folder}/{MANIFEST}") as out:
            out.write(json.dumps(names).encode())

    def abort(self, messages: list[_Written]) -> None:
        store, folder = store_of(self.path)
        for name in (n for m in messages if m for n in m.files):
            store.delete_file(f"{folder}/{name}")


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    columns = {n: batch.column(n) for n in batch.schema.names}
    for i in range(batch.num_rows):
        yield {n: c[i].as_py() for n, c in columns.items()}


# Reading

def _headers(block: bytes) -> dict[str, str]:
    lines = block.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    pairs = (x.partition(":") for x in lines[1:] if x)
    return {name.strip().lower(): value.strip() for name, _, value in pairs}


def _row(headers: dict[str, str]) -> dict:
    row = {c: headers.get(h.lower()) for c, h in HEADERS.items()}
    if row["payload_digest"]:
        row["payload_digest"] = row["payload_digest"].rpartition(":")[2]
    row["payload_bytes"] = int(row["payload_bytes"]) if row["payload_bytes"] else None
    return row


def _payload(headers: dict[str, str], content: bytes) -> bytes:
    if headers.get("content-type", "").startswith("application/http"):
        return content.partition(_END)[2]
    return content


def read_records(f, wanted: Callable[[dict], bool], payload: bool = True) -> Iterator[dict]:
    """Rows of the records in file ``f`` whose headers are ``wanted``."""
    while True:
        at = f.tell()
        head = f.read(24)
        if not head:
            return
        if head[:4] == b"\x1f\x8b\x08\x04" and head[12:16] == b"sl\x08\x00":
            size = struct.unpack("<I", head[16:20])[0]
            unpack, text = zlib.decompressobj(-15), b""
            left = size - 24
            while _END not in text and left > 0:
                chunk = f.read(min(_CHUNK, left))
                left -= len(chunk)
                text += unpack.decompress(chunk, _CHUNK)
                while _END not in text and unpack.unconsumed_tail:
                    text += unpack.decompress(unpack.unconsumed_tail, _CHUNK)
            block, _, start = text.partition(_END)
            headers = _headers(block)
            row = _row(headers)
            if wanted(row):
                row["payload"] = None
                if payload:
                    rest = unpack.decompress(unpack.unconsumed_tail + f.read(left)) + unpack.flush()
                    row["payload"] = _payload(headers, (start + rest)[: int(headers["content-length"])])
                yield row
            f.seek(at + size)
            continue
        f.seek(at)
        yield from _streamed(gzip.GzipFile(fileobj=f) if head[:2] == b"\x1f\x8b" else f, wanted, payload)
        return


def _streamed(f, wanted: Callable[[dict], bool], payload: bool) -> Iterator[dict]:
    """Records of a file without member lengths, one after the other."""
    while True:
        line = f.readline()
        while line in (b"\r\n", b"\n"):
            line = f.readline()
        if not line:
            return
        block = b""
        while line not in (b"\r\n", b"\n", b""):
            block += line.rstrip(b"\r\n") + b"\r\n"
            line = f.readline()
        headers = _headers(block)
        row, size = _row(headers), int(headers["content-length"])
        if wanted(row):
            content = f.read(size)
            row["payload"] = _payload(headers, content) if payload else None
            yield row
        else:
            f.seek(f.tell() + size)


@dataclass
class _File(InputPartition):
    path: str


class WarcReader(DataSourceReader):
    def __init__(self, path: str, payload: bool) -> None:
        self.path, self.payload, self.tests = path, payload, []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Keep those on header columns that the headers alone decide."""
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if column in HEADERS and isinstance(f, (EqualTo, In, IsNotNull, StringStartsWith)):
                self.tests.append((type(f).__name__, column, getattr(f, "value", None)))
            else:
                yield f

    def partitions(self) -> list[_File]:
        store, folder = store_of(self.path)
        if store.get_file_info(f"{folder}/{MANIFEST}").type == fs.FileType.File:
            names = json.loads(store.open_input_stream(f"{folder}/{MANIFEST}").read())
        else:
            found = store.get_file_info(fs.FileSelector(folder))
            names = sorted(x.base_name for x in found if x.base_name.endswith((".warc", ".warc.gz")))
        return [_File(f"{self.path.rstrip('/')}/{n}") for n in names] or [_File("")]

    def wanted(self, row: dict) -> bool:
        for kind, column, value in self.tests:
            held = row[column]
            if held is None or (kind == "EqualTo" and held != value) or (kind == "In" and held not in value) or (
                    kind == "StringStartsWith" and not held.startswith(value)):
                return False
        return True

    def read(self, partition: _File) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        store, path = store_of(partition.path)
        rows, size = [], 0
        with store.open_input_file(path) as f:
            for row in read_records(f, self.wanted, self.payload):
                rows.append(row)
                size += 200 + len(row["payload"] or b"")
                if size >= _BATCH_BYTES:
                    yield pa.RecordBatch.from_pylist(rows, _ARROW)
                    rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, _ARROW)


_ARROW = pa.schema([
    *((c, pa.int64() if c == "payload_bytes" else pa.string()) for c in HEADERS), ("payload", pa.binary())])


class WarcDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(self.options["path"], self.options.get("payload", "true").lower() == "true")

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"])


def write_warc(records: DataFrame, path: str) -> None:
    """Write rows of ``SCHEMA`` as archives under ``path``, a new folder."""
    records.sparkSession.dataSource.register(WarcDataSource)
    records.write.format("warc").mode("append").save(path)


def read_warc(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """Records of the archives under ``path``; filters on headers are pushed to the reader."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)


# Archives of pages

def page_records(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """A record per page: pages with equal payloads revisit the one with the smallest id.

    Defined results: a null payload is empty; payloads under ``MIN_REVISIT_BYTES``
    are all responses; rows that share the smallest id are all responses; a page
    without an id revisits the smallest id if its group has one; a null URL leaves
    the header out; an empty table gives no archives.
    """
    payload = F.encode(whole(F.col(html)), "UTF-8")
    rows = pages.select(F.col(key).cast("long").alias("id"), F.col(url).alias("target_uri"), payload.alias("payload"),
                        F.sha2(payload, 256).alias("digest"), F.octet_length(payload).cast("long").alias("size"))
    groups = rows.where(F.col("size") >= MIN_REVISIT_BYTES).groupBy("digest").agg(
        F.min("id").alias("first"), F.count("*").alias("pages"))
    groups = groups.where("pages > 1 AND first IS NOT NULL").select(F.col("digest").alias("same"), "first")
    joined = rows.join(groups, rows.digest == groups.same, "left")
    again = F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))

    def name(column: str) -> Column:
        return F.concat(F.lit("<urn:page:"), F.col(column), F.lit(">"))

    return joined.select(
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        F.coalesce(name("id"), F.concat(F.lit("<urn:sha256:"), F.col("digest"), F.lit(">"))).alias("record_id"),
        "target_uri",
        F.lit(_DATE).alias("date"),
        F.when(again, name("first")).alias("refers_to"),
        F.col("digest").alias("payload_digest"),
        F.col("size").alias("payload_bytes"),
        F.when(~again, F.col("payload")).alias("payload"),
    )


def page_id(name: Column) -> Column:
    """The page id in a record id, or null."""
    return F.regexp_extract(name, r"^<urn:page:(-?\d+)>$", 1).try_cast("long")


def archive_pages(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Write ``pages`` as archives and return what the archives hold, read back."""
    spark = pages.sparkSession
    path = path or new_work_path(spark, "warc")
    write_warc(page_records(pages), path)
    return read_warc(spark, path)
