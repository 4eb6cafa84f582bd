"""WARC archives: writing with revisits, and a data source that reads headers first.

Archives are ``.warc.gz`` files of one gzip member per record. The writer notes a member's length in its gzip header
(an extra field, which other readers pass over), so this reader finds the next record without inflating the one before;
members without the note are inflated up to their end. Plain ``.warc`` files are read by seeking over the content.

Each task writes one file under a name of its own and reports it; a manifest of the files of all successful
attempts is written by Spark. The reader reads what a manifest lists, so files of lost or repeated attempts are never read.

Reading plans one partition per archive. Filters of equality and membership on ``type``, ``record_id``, ``target_uri``,
``payload_digest`` and ``refers_to`` are applied to the headers as soon as they are read; content of other records is
neither inflated nor decoded, nor is any with the option ``payload`` set to ``false``.

Defined cases: a null payload is empty; a null URL gives a record without a target; a null id is written as the word null and
read as null; equal ids are separate records, and revisits name the smallest id; an empty table gives no record. Extra columns
are passed over.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from lifeframe.session import scratch_path

MIN_REVISIT = 100  # bytes; smaller payloads are written again
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ID_PREFIX = "urn:record:"
SCHEMA = (
    "record_id string, type string, target_uri string, date string, payload_digest string, payload_length bigint, refers_to string, payload binary"
)
FIELDS = ("record_id", "type", "target_uri", "date", "payload_digest", "payload_length", "refers_to")
_NOTE = b"LF"  # marks the member's length among the extra fields
_HEAD = 64 << 10


def open_store(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path as Spark writes it."""
    for ours, theirs in (("s3a://", "s3://"), ("s3n://", "s3://")):
        if uri.startswith(ours):
            uri = theirs + uri[len(ours) :]
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[len("file:") :]
    return pafs.FileSystem.from_uri(uri if "://" in uri else os.path.abspath(uri))


def member(record: bytes, level: int = 3) -> bytes:
    """One gzip member with its own length in an extra field."""
    packer = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = packer.compress(record) + packer.flush()
    size = 10 + 2 + 8 + len(body) + 8
    head = b"\x1f\x8b\x08\x04" + bytes(4) + b"\x00\xff" + struct.pack("<H", 8) + _NOTE + struct.pack("<HI", 4, size)
    return head + body + struct.pack("<II", zlib.crc32(record), len(record) & 0xFFFFFFFF)


def _line(value: str) -> str:
    """A header value on one line."""
    return value.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")


def _unline(value: str) -> str:
    return value.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")


def record_bytes(id_: str | None, url: str | None, date: str, payload: bytes, digest: str, refers_to: str | None) -> bytes:
    """A response record, or a revisit of the record ``refers_to`` that repeats the HTTP header only."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    content = http + payload if refers_to is None else http
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", f"<{ID_PREFIX}{'null' if id_ is None else _line(id_)}>"),
        ("WARC-Date", date),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("WARC-Payload-Length", str(len(payload))),
    ]
    if url is not None:
        fields.append(("WARC-Target-URI", _line(url)))
    if refers_to is not None:
        fields += [("WARC-Refers-To", f"<{ID_PREFIX}{_line(refers_to)}>"), ("WARC-Profile", PROFILE)]
    fields += [("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(content)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return head.encode() + content + b"\r\n\r\n"


def write(pages: DataFrame, path: str, id_col: str = "page_id", url: str = "url", payload: str = "html", date: str = "2000-01-01T00:00:00Z") -> None:
    """Write a record per row under ``path`` and the manifest ``path``/manifest.

    Of payloads that are equal, the one with the smallest id is a response and the others revisit it. First ids are
    found from digests alone, and only those of repeated payloads are joined to the rows; the join can be split.
    """
    raw = F.coalesce(F.col(payload).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url).cast("string").alias("url"), raw.alias("payload"))
    marked = rows.withColumn("digest", F.sha2("payload", 256))
    counted = marked.filter(F.octet_length("payload") >= MIN_REVISIT).groupBy("digest")
    firsts = counted.agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("digest", "first")
    joined = marked.join(firsts, "digest", "left")
    refers = F.when(~F.col("id").eqNullSafe(F.col("first")), F.col("first").cast("string"))
    ready = joined.select(F.col("id").cast("string").alias("id"), "url", "payload", "digest", refers.alias("refers"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = open_store(path)
        store.create_dir(root, recursive=True)
        name, records = f"{uuid.uuid4().hex}.warc.gz", 0
        with store.open_output_stream(f"{root}/{name}", compression=None) as out:
            for batch in batches:
                for id_, link, body, digest, first in zip(*(c.to_pylist() for c in batch.columns)):
                    out.write(member(record_bytes(id_, link, date, body, digest, first)))
                    records += 1
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([records], pa.int64())], ["file", "records"])

    ready.mapInArrow(run, "file string, records bigint").write.parquet(f"{path}/manifest")


class Archive:
    """Records of one file in turn: headers at once, content on demand."""

    def __init__(self, file: BinaryIO, size: int):
        self.file, self.size, self.at = file, size, 0

    def __iter__(self) -> Iterator[tuple[dict[str, str], object]]:
        while self.at < self.size:
            self.file.seek(self.at)
            head = self.file.read(_HEAD)
            yield from self._zipped(head) if head[:2] == b"\x1f\x8b" else self._plain(head)

    def _fields(self, head: bytes, more) -> tuple[dict[str, str], bytes]:
        """Header fields in lower case, and what has been read behind them."""
        while b"\r\n\r\n" not in head:
            part = more()
            if not part:
                raise ValueError(f"record at byte {self.at} has no complete header")
            head += part
        text, _, rest = head.partition(b"\r\n\r\n")
        lines = text.decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record begins at byte {self.at}")
        pairs = (line.partition(":") for line in lines[1:])
        return {k.strip().lower(): v.strip() for k, _, v in pairs}, rest

    def _plain(self, head: bytes):
        fields, rest = self._fields(head, lambda: self.file.read(_HEAD))
        begin = self.file.tell() - len(rest)
        length = int(fields["content-length"])

        def content() -> bytes:
            self.file.seek(begin)
            return self.file.read(length)

        self_at = begin + length + 4
        yield fields, content
        self.at = self_at

    def _zipped(self, head: bytes):
        size = self._noted(head)
        inflate = zlib.decompressobj(31)
        pending = [head[:size] if size else head]
        read = len(pending[0])

        def more(limit: int = 4096) -> bytes:
            nonlocal read
            while not inflate.eof:
                source = inflate.unconsumed_tail or (pending.pop() if pending else b"")
                part = inflate.decompress(source, limit)  # without input, what zlib still holds
                if part:
                    return part
                if not inflate.unconsumed_tail and not pending and not inflate.eof:
                    pending.append(self.file.read(min(_HEAD, size - read) if size else _HEAD))
                    read += len(pending[0])
                    if not pending[0]:
                        raise ValueError(f"member at byte {self.at} is cut off")
            return b""

        fields, rest = self._fields(more(), more)
        length = int(fields["content-length"])
        parts = [rest]

        def content() -> bytes:
            while sum(map(len, parts)) < length:
                part = more(1 << 20)
                if not part:
                    raise ValueError(f"member at byte {self.at} is cut off")
                parts.append(part)
            return b"".join(parts)[:length]

        yield fields, content
        if not size:
            while more(1 << 20):
                pass
            size = read - len(inflate.unused_data)
        self.at += size

    @staticmethod
    def _noted(head: bytes) -> int:
        """The member's length, if noted in its header."""
        if len(head) < 12 or not head[3] & 4:
            return 0
        extra, k = head[12 : 12 + struct.unpack_from("<H", head, 10)[0]], 0
        while k + 4 <= len(extra):
            kind, length = extra[k : k + 2], struct.unpack_from("<H", extra, k + 2)[0]
            if kind == _NOTE and length == 4:
                return struct.unpack_from("<I", extra, k + 4)[0]
            k += 4 + length
        return 0


def _named(value: str | None) -> str | None:
    """A record's id as it was written."""
    if value is None:
        return None
    bare = value.strip("<>")
    bare = bare[len(ID_PREFIX) :] if bare.startswith(ID_PREFIX) else bare
    return None if bare == "null" else _unline(bare)


def header_row(fields: dict[str, str]) -> dict[str, object]:
    url, length = fields.get("warc-target-uri"), fields.get("warc-payload-length")
    return {
        "record_id": _named(fields.get("warc-record-id")),
        "type": fields.get("warc-type"),
        "target_uri": _unline(url) if url is not None else None,
        "date": fields.get("warc-date"),
        "payload_digest": fields["warc-payload-digest"].partition(":")[2] if "warc-payload-digest" in fields else None,
        "payload_length": int(length) if length is not None else None,
        "refers_to": _named(fields.get("warc-refers-to")),
    }


def payload_of(content: bytes, fields: dict[str, str]) -> bytes:
    """Without the HTTP header, where the content has one."""
    if fields.get("content-type", "").startswith("application/http"):
        return content.partition(b"\r\n\r\n")[2]
    return content


class WarcPartition(InputPartition):
    def __init__(self, file: str):
        self.file = file


class WarcReader(DataSourceReader):
    """Plans a partition per archive; see the module text for the filters."""

    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.files = [f for f in options.get("files", "").split("\n") if f]
        self.want_payload = options.get("payload", "true").lower() != "false"
        self.allowed: dict[str, set] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            values = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            name = f.attribute[0] if values is not None and len(f.attribute) == 1 else None
            if name in FIELDS:
                self.allowed[name] = self.allowed[name] & values if name in self.allowed else values
            else:
                yield f

    def partitions(self) -> list[WarcPartition]:
        files = self.files
        if not files:
            store, root = open_store(self.path)
            listed = store.get_file_info(pafs.FileSelector(root, recursive=True))
            files = sorted(x.path[len(root) :].lstrip("/") for x in listed if x.path.endswith((".warc", ".warc.gz")))
        return [WarcPartition(f) for f in files]

    def read(self, partition: WarcPartition) -> Iterator[pa.RecordBatch]:
        names = [*FIELDS, "payload"]
        kinds = {"payload_length": pa.int64(), "payload": pa.binary()}
        if partition is None or not hasattr(partition, "file"):
            return
        store, root = open_store(self.path)
        rows: list[list] = []
        held = 0
        with store.open_input_file(f"{root}/{partition.file}") as file:
            for fields, content in Archive(file, file.size()):
                row = header_row(fields)
                if any(row[n] not in values for n, values in self.allowed.items()):
                    continue
                body = payload_of(content(), fields) if self.want_payload else None
                rows.append([*(row[n] for n in FIELDS), body])
                held += len(body or b"")
                if len(rows) == 2000 or held > 8 << 20:
                    yield self._batch(rows, names, kinds)
                    rows, held = [], 0
        if rows:
            yield self._batch(rows, names, kinds)

    @staticmethod
    def _batch(rows: list[list], names: list[str], kinds: dict[str, pa.DataType]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, kinds.get(n, pa.string())) for n, c in zip(names, zip(*rows))], names)


class WarcDataSource(DataSource):
    """``spark.read.format("warc").load(folder)``; options ``payload`` and ``files`` (one name per line)."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options)


def read(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """The records of the archives that the manifest under ``path`` lists, or of all archives where there is none.

    File names come to the driver, one per task that wrote; records don't.
    """
    spark.dataSource.register(WarcDataSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    reader = spark.read.format("warc").option("payload", str(payload).lower())
    jvm = spark.sparkContext._jvm.org.apache.hadoop.fs
    manifest = jvm.Path(f"{path}/manifest")
    if manifest.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(manifest):
        files = [r["file"] for r in spark.read.parquet(f"{path}/manifest").filter("records > 0").select("file").collect()]
        reader = reader.option("files", "\n".join(files) or "none.warc.absent")
        if not files:
            return spark.createDataFrame([], SCHEMA)
    return reader.load(path)


def round_trip(pages: DataFrame, id_col: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """Write archives to the shared folder and read them back: (id, payload_bytes, payload_digest, type, refers_to).

    A response's length and digest are those of the payload read; a revisit has them in its header. Revisits are
    read with headers only.
    """
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    write(pages, path, id_col, url, payload)
    kind = pages.schema[id_col].dataType
    whole = read(spark, path).filter("type = 'response'")
    full = whole.select("record_id", F.octet_length("payload").cast("long").alias("n"), F.sha2("payload", 256).alias("digest"), "type", "refers_to")
    bare = read(spark, path, payload=False).filter("type = 'revisit'").select("record_id", "payload_length", "payload_digest", "type", "refers_to")
    both = full.union(bare).toDF("id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    return both.withColumns({"id": F.col("id").cast(kind), "refers_to": F.col("refers_to").cast(kind)})
