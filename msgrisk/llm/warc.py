"""WARC archives as a PySpark data source, with page writing and revisit records.

Every record is a gzip member of its own whose header tells the member's length (extra field ``sl``), so a
reader that does not want a payload goes on to the next record without decompressing it.  Archives without
that field, and plain ``.warc`` files, are read too.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, StringStartsWith,
    WriterCommitMessage,
)
from pyspark.sql.types import StructType

SCHEMA = (
    "page_id long, record_type string, record_id string, target_uri string, payload_digest string, "
    "payload_bytes long, refers_to long, payload binary"
)
HEADERS = {      # columns that come from one header
    "page_id": "X-Page-Id", "record_type": "WARC-Type", "record_id": "WARC-Record-ID", "target_uri": "WARC-Target-URI",
    "payload_digest": "WARC-Payload-Digest", "payload_bytes": "X-Payload-Length", "refers_to": "X-Refers-To-Page",
}
NUMBERS = ("page_id", "payload_bytes", "refers_to")
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
FILE_BYTES = 64 << 20
PARTITION_BYTES = 32 << 20
_BATCH_BYTES = 8 << 20


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


# ------------------------------------------------------------------ one record
def _member(record: bytes) -> bytes:
    """A gzip member whose extra field holds its whole length."""
    packer = zlib.compressobj(1, zlib.DEFLATED, -15)
    body = packer.compress(record) + packer.flush()
    tail = struct.pack("<II", zlib.crc32(record), len(record) & 0xFFFFFFFF)
    extra = b"sl" + struct.pack("<HQ", 8, 10 + 2 + 12 + len(body) + 8)
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", len(extra)) + extra + body + tail


def _clean(value: str) -> str:
    return "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in value)


def _record(row: dict, date: str) -> bytes:
    payload = row["payload"] or b""
    revisit = row["record_type"] == "revisit"
    block = HTTP_HEAD if revisit else HTTP_HEAD + payload
    lines = [("WARC-Type", row["record_type"]), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", date)]
    if row["url"] is not None:
        lines.append(("WARC-Target-URI", _clean(row["url"])))
    lines += [("WARC-Payload-Digest", f"sha1:{payload_digest(payload)}"), ("X-Payload-Length", len(payload))]
    if row["page_id"] is not None:
        lines.append(("X-Page-Id", row["page_id"]))
    if revisit:
        lines += [("WARC-Profile", REVISIT_PROFILE), ("X-Refers-To-Page", row["refers_to"])]
    lines += [("Content-Type", "application/http;msgtype=response"), ("Content-Length", len(block))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines) + "\r\n"
    return _member(head.encode() + block + b"\r\n\r\n")


def _parse(head: bytes) -> dict[str, str]:
    first, *lines = head.decode("utf-8", "replace").split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError(f"not a WARC record: {first[:40]!r}")
    pairs = (line.partition(":") for line in lines if ":" in line)
    return {k.strip().lower(): v.strip() for k, _, v in pairs}


class _Records:
    """Goes through the records of one open file: headers first, blocks only when asked for."""

    def __init__(self, file):
        self.file, self.at, self.size = file, 0, file.size()

    def __iter__(self) -> Iterator[dict[str, str]]:
        while self.at < self.size:
            self.file.seek(self.at)
            self._chunk = self.file.read(4096)
            if self._chunk[:2] == b"\x1f\x8b":
                self._packed = zlib.decompressobj(31)
                self._data = self._packed.decompress(self._chunk)
            else:
                self._packed, self._data = None, self._chunk
            while (end := self._data.find(b"\r\n\r\n")) < 0:
                if not self._more():
                    raise ValueError(f"record at byte {self.at} has no end of its headers")
            headers = _parse(self._data[:end])
            self._block_at, self._length = end + 4, int(headers["content-length"])
            self._used = False
            yield headers
            self._forward()

    def _more(self) -> bool:
        """Takes in the next bytes of the record."""
        if self._packed is not None and self._packed.eof:
            return False
        chunk = self.file.read(1 << 16)
        self._data += chunk if self._packed is None else self._packed.decompress(chunk)
        return bool(chunk)

    def block(self) -> bytes:
        parts, size = [self._data], len(self._data)
        while size < self._block_at + self._length:
            before, self._data = self._data, b""
            if not self._more() and not self._data:
                raise ValueError(f"record at byte {self.at} is cut off")
            parts.append(self._data)
            size += len(self._data)
        self._data = b"".join(parts)
        return self._data[self._block_at : self._block_at + self._length]

    def _forward(self) -> None:
        if self._packed is None:
            self.at += self._block_at + self._length + 4
            return
        flags, extra = self._chunk[3], b""
        if flags & 4:
            n = struct.unpack_from("<H", self._chunk, 10)[0]
            extra = self._chunk[12 : 12 + n]
        while len(extra) >= 4:
            n = struct.unpack_from("<H", extra, 2)[0]
            if extra[:2] == b"sl" and n == 8:
                self.at += struct.unpack_from("<Q", extra, 4)[0]
                return
            extra = extra[4 + n :]
        while not self._packed.eof:
            self._data = b""
            if not self._more():
                raise ValueError(f"record at byte {self.at} is cut off")
        self.at = self.file.tell() - len(self._packed.unused_data)


# ---------------------------------------------------------------- data source
@dataclass
class Files(InputPartition):
    paths: list = field(default_factory=list)

    def __init__(self, paths):
        super().__init__(0)
        self.paths = paths


@dataclass
class Written(WriterCommitMessage):
    names: list


def _store(path: str):
    system, root = pyarrow.fs.FileSystem.from_uri(path if ":/" in path else f"file://{path}")
    return system, root.rstrip("/")


class WarcSource(DataSource):
    """Options: ``path``; ``date`` (written records); ``verify`` (decode every response and compare its digest)."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return WarcReader(schema, dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return WarcWriter(dict(self.options), overwrite)


class WarcReader(DataSourceReader):
    """Columns are those of the read schema; without ``payload`` among them no block is decoded."""

    def __init__(self, schema: StructType, options: dict):
        self.names, self.options, self.tests = schema.names, options, []
        self.arrow = pa.schema([(n, pa.binary() if n == "payload" else pa.int64() if n in NUMBERS else pa.string()) for n in self.names])

    def pushFilters(self, filters: list[Filter]):
        for item in filters:
            name = item.attribute[0] if hasattr(item, "attribute") and len(item.attribute) == 1 else ""
            if name in HEADERS and isinstance(item, (EqualTo, In, StringStartsWith)):
                values = tuple(item.value) if isinstance(item, In) else item.value
                self.tests.append((name, type(item).__name__, values))
            else:
                yield item

    def partitions(self) -> list[InputPartition]:
        """Whole files, small ones together; those of finished writes only, if the folder has lists of them."""
        system, root = _store(self.options["path"])
        info = [f for f in system.get_file_info(pyarrow.fs.FileSelector(root)) if f.is_file]
        lists = [f.path for f in info if f.base_name.startswith("_written-")]
        files = {f.path: f.size for f in info if f.base_name.endswith((".warc", ".warc.gz"))}
        if lists:
            done = set()
            for path in lists:
                with system.open_input_stream(path) as f:
                    done.update(f"{root}/{name}" for name in json.loads(f.read()))
            files = {p: n for p, n in files.items() if p in done}
        out, size = [], PARTITION_BYTES
        for path, n in sorted(files.items()):
            if size + n > PARTITION_BYTES:
                out.append(Files([]))
                size = 0
            out[-1].paths.append(path)
            size += n
        return out or [Files([])]

    def _wanted(self, row: dict) -> bool:
        for name, kind, value in self.tests:
            own = row[name]
            if own is None or not (own in value if kind == "In" else own.startswith(value) if kind == "StringStartsWith" else own == value):
                return False
        return True

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        system, _ = _store(self.options["path"])
        verify = self.options.get("verify", "false").lower() == "true"
        rows, size = [], 0
        for path in partition.paths:
            with system.open_input_file(path) as file:
                records = _Records(file)
                for headers in records:
                    row = {c: headers.get(h.lower()) for c, h in HEADERS.items()}
                    row |= {c: int(row[c]) for c in NUMBERS if row[c] is not None}
                    row["payload_digest"] = (row["payload_digest"] or "").removeprefix("sha1:") or None
                    if not self._wanted(row):
                        continue
                    if row["record_type"] == "response" and (verify or "payload" in self.names):
                        row["payload"] = records.block().partition(b"\r\n\r\n")[2]
                        if verify and payload_digest(row["payload"]) != row["payload_digest"]:
                            raise ValueError(f"{path}: payload of {row['record_id']} differs from its digest")
                        row["payload_bytes"] = len(row["payload"])
                    rows.append([row.get(n) for n in self.names])
                    size += 200 + (len(row["payload"]) if "payload" in self.names and row.get("payload") else 0)
                    if size > _BATCH_BYTES:
                        yield self._batch(rows)
                        rows, size = [], 0
        if rows:
            yield self._batch(rows)

    def _batch(self, rows: list) -> pa.RecordBatch:
        columns = list(zip(*rows)) if self.names else []
        return pa.record_batch([pa.array(c, t.type) for c, t in zip(columns, self.arrow)], schema=self.arrow)


class WarcWriter(DataSourceArrowWriter):
    """Each task writes files of its own name; they count once the list of a finished write names them."""

    def __init__(self, options: dict, overwrite: bool):
        self.options, self.overwrite, self.job = options, overwrite, uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, root = _store(self.options["path"])
        system.create_dir(root, recursive=True)
        date, names, out, size = self.options.get("date", "2024-01-01T00:00:00Z"), [], None, 0
        for batch in iterator:
            for row in batch.to_pylist():
                if out is None or size > FILE_BYTES:
                    if out is not None:
                        out.close()
                    names.append(f"{uuid.uuid4().hex}.warc.gz")
                    out, size = system.open_output_stream(f"{root}/{names[-1]}", compression=None), 0
                size += out.write(_record(row, date)) or 0
        if out is not None:
            out.close()
        return Written(names)

    def commit(self, messages: list) -> None:
        system, root = _store(self.options["path"])
        system.create_dir(root, recursive=True)
        if self.overwrite:
            for f in system.get_file_info(pyarrow.fs.FileSelector(root)):
                if f.base_name.startswith("_written-"):
                    system.delete_file(f.path)
        with system.open_output_stream(f"{root}/_written-{self.job}.json", compression=None) as f:
            f.write(json.dumps([n for m in messages if m for n in m.names]).encode())

    def abort(self, messages: list) -> None:
        system, root = _store(self.options["path"])
        for name in (n for m in messages if m for n in m.names):
            system.delete_file(f"{root}/{name}")


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def with_revisits(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Columns page_id, url, payload, record_type, refers_to for pages (page_id, url, html).

    Of equal payloads of at least ``least_bytes`` that with the least page_id is the response (all rows of
    it, if the id repeats) and the others revisit it; smaller ones are all responses.  Null html is empty.
    Rows without page_id revisit the response of an id, or are responses if there is none.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.unhex(F.sha1("payload")))
    sums = rows.where(F.octet_length("payload") >= least_bytes).groupBy(F.hex("digest").alias("name"))
    first = sums.agg(F.min("page_id").alias("first")).select(F.unhex("name").alias("digest"), "first")
    rows = rows.join(first, "digest", "left")
    own = F.col("first").isNull() | F.col("page_id").eqNullSafe(F.col("first"))
    return rows.select(
        "page_id", "url", "payload", F.when(own, "response").otherwise("revisit").alias("record_type"),
        F.when(~own, F.col("first")).alias("refers_to"),
    )


def write_pages(pages: DataFrame, path: str, least_bytes: int = 0) -> None:
    """Archive pages under a folder that all executors share."""
    register(pages.sparkSession)
    with_revisits(pages, least_bytes).write.format("warc").mode("append").option("path", path).save()


def read_records(spark: SparkSession, path: str, columns: str = SCHEMA, verify: bool = False) -> DataFrame:
    register(spark)
    reader = spark.read.format("warc").schema(columns).option("path", path)
    return reader.option("verify", str(verify).lower()).load()
