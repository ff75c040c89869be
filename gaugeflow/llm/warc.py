"""A Spark data source for WARC archives.

``spark.read.format("warc").load(path)`` plans one partition per group of files,
pushes predicates on the record type and on headers down to the reader, parses a
record's headers first and skips its block unless the record is wanted and its
payload asked for.  Records are gzip members of their own; members written here
carry their length in an ``SL`` extra field, so an unwanted one is skipped
without being inflated.  Members without the field, and plain ``.warc`` files,
are read as well.  Files are read through one window, so bytes are fetched once,
and skips beyond it are not fetched at all.

``df.write.format("warc").mode("append").save(path)`` writes such archives.  A
task writes files under names of its own attempt and the commit adds a manifest
that lists the files of the successful tasks; the reader follows the manifests,
so lost executors and repeated attempts leave no extra records.  Paths are
completed by Hadoop's default file system, as Spark's own are.

Defined results: a null payload is empty; null headers are left out and read as
null; control characters in headers are percent-encoded; an empty table gives an
archive without records, read as an empty table; a record cut off at the end of
a file raises an error.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    Filter,
    In,
    InputPartition,
    IsNotNull,
    IsNull,
    WriterCommitMessage,
)

from gaugeflow.llm.runtime import materialize, sided

SCHEMA = (
    "record_type string, record_id string, target_uri string, payload_digest string, "
    "payload_bytes long, refers_to string, payload binary"
)
HEADERS = ("record_type", "record_id", "target_uri", "payload_digest", "refers_to")
#: A file is closed once it holds so many bytes.
FILE_BYTES = 64 << 20
#: Equal payloads of fewer bytes are stored again.
REVISIT_BYTES = 100
_CHUNK = 64 << 10
#: Bytes that are fetched from a file at a time.
_WINDOW = 1 << 20
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` with the scheme and authority that Hadoop's configuration gives it."""
    named = spark._jvm.org.apache.hadoop.fs.Path(path)
    return named.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(named).toString()


def store(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path and the path in it; ``s3a`` and ``s3n`` are ``s3``."""
    path = re.sub(r"^s3[an]://", "s3://", path)
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def _clean(value: str) -> str:
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def encode(record: dict) -> bytes:
    """One record as a gzip member.  ``payload_bytes`` is the length of the full payload."""
    payload = record["payload"] or b""
    revisit = record["record_type"] == "revisit"
    http = (
        "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
        f"Content-Length: {record['payload_bytes']}\r\n\r\n"
    ).encode()
    block = http if revisit else http + payload
    lines = [f"WARC/1.1\r\nWARC-Type: {record['record_type']}\r\nWARC-Date: 1970-01-01T00:00:00Z"]
    for name, key, shown in (
        ("WARC-Record-ID", "record_id", "<{}>"),
        ("WARC-Target-URI", "target_uri", "{}"),
        ("WARC-Payload-Digest", "payload_digest", "sha-256:{}"),
        ("WARC-Refers-To", "refers_to", "<{}>"),
    ):
        if record[key] is not None:
            lines.append(f"{name}: {shown.format(_clean(record[key]))}")
    if revisit:
        lines.append(f"WARC-Profile: {_PROFILE}")
    lines.append(f"Content-Type: application/http; msgtype=response\r\nContent-Length: {len(block)}\r\n\r\n")
    raw = "\r\n".join(lines).encode() + block + b"\r\n\r\n"
    deflate = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = deflate.compress(raw) + deflate.flush()
    length = 24 + len(body) + 8
    sl = struct.pack("<II", length if length < 2**32 else 0, len(raw) % 2**32)
    head = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", 12) + b"SL" + struct.pack("<H", 8) + sl
    return head + body + struct.pack("<II", zlib.crc32(raw), len(raw) % 2**32)


class _Window:
    """A file read in pieces of ``_WINDOW`` bytes; places in the current piece cost no access."""

    def __init__(self, file):
        self.file, self.at, self.begin, self.data = file, 0, 0, b""

    def read(self, n: int) -> bytes:
        parts = []
        while n > 0:
            inside = self.at - self.begin
            if not 0 <= inside < len(self.data):
                self.file.seek(self.at)
                self.begin, self.data, inside = self.at, self.file.read(_WINDOW), 0
                if not self.data:
                    break
            parts.append(self.data[inside : inside + n])
            self.at += len(parts[-1])
            n -= len(parts[-1])
        return b"".join(parts)

    def seek(self, place: int) -> None:
        self.at = place

    def tell(self) -> int:
        return self.at


class _Plain:
    """An uncompressed record stream."""

    def __init__(self, file, at: int):
        self.file, self.pending, self.at = file, b"", at

    def read(self, n: int) -> bytes:
        while len(self.pending) < n and (more := self.file.read(_CHUNK)):
            self.pending += more
        out, self.pending = self.pending[:n], self.pending[n:]
        return out

    def head(self) -> bytes:
        while (at := self.pending.find(b"\r\n\r\n")) < 0 and (more := self.file.read(_CHUNK)):
            self.pending += more
        if at < 0:
            if self.pending.strip():
                raise ValueError("a record is cut off in its headers")
            return b""
        out, self.pending = self.pending[:at], self.pending[at + 4 :]
        return out

    def skip(self, n: int) -> None:
        inside = min(n, len(self.pending))
        self.pending = self.pending[inside:]
        if n > inside:
            self.file.seek(self.file.tell() + n - inside)

    def close(self) -> None:
        self.skip(4)


class _Member:
    """A gzip member that holds one record; inflates only what is asked for."""

    def __init__(self, file, start: int):
        self.file, self.start, self.length = file, start, 0
        file.seek(start)
        fixed = file.read(10)
        if len(fixed) < 10 or fixed[:3] != b"\x1f\x8b\x08":
            raise ValueError(f"no gzip member at byte {start}")
        flags = fixed[3]
        if flags & 4:
            extra = file.read(struct.unpack("<H", file.read(2))[0])
            while len(extra) >= 4:
                size = struct.unpack("<H", extra[2:4])[0]
                if extra[:2] == b"SL":
                    self.length = struct.unpack("<I", extra[4:8])[0]
                extra = extra[4 + size :]
        for _ in range(bool(flags & 8) + bool(flags & 16)):
            while file.read(1) not in (b"\0", b""):
                pass
        if flags & 2:
            file.read(2)
        self.inflate, self.out, self.fed = zlib.decompressobj(-15), b"", b""

    def _more(self, most: int) -> bool:
        """Inflate up to ``most`` more bytes; False at the end of the member."""
        if self.inflate.eof:
            return False
        if not self.fed:
            left = self.start + self.length - self.file.tell() if self.length else _CHUNK
            self.fed = self.file.read(min(_CHUNK, max(1, left)))
            if not self.fed:
                raise ValueError(f"the record at byte {self.start} is cut off")
        self.out += self.inflate.decompress(self.fed, most)
        self.fed = self.inflate.unconsumed_tail
        return True

    def head(self) -> bytes:
        while (at := self.out.find(b"\r\n\r\n")) < 0:
            if not self._more(2048):
                raise ValueError(f"the record at byte {self.start} has no headers")
        out, self.out = self.out[:at], self.out[at + 4 :]
        return out

    def read(self, n: int) -> bytes:
        parts, have = [self.out], len(self.out)
        while have < n:
            self.out = b""
            if not self._more(max(1, n - have)):
                raise ValueError(f"the record at byte {self.start} is cut off")
            parts.append(self.out)
            have += len(self.out)
        whole = b"".join(parts)
        self.out = whole[n:]
        return whole[:n]

    def end(self) -> int:
        """Where the next member begins."""
        if self.length:
            return self.start + self.length
        while not self.inflate.eof:
            self.out = b""
            self._more(_CHUNK)
        return self.file.tell() - len(self.inflate.unused_data) + 8  # behind checksum and length


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:60]!r}")
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}


def _row(fields: dict[str, str]) -> dict:
    """A row from the headers, without its payload."""
    bare = lambda v: v[1:-1] if v is not None and v[:1] == "<" else v
    digest = fields.get("warc-payload-digest")
    return {
        "record_type": fields.get("warc-type"),
        "record_id": bare(fields.get("warc-record-id")),
        "target_uri": fields.get("warc-target-uri"),
        "payload_digest": digest.partition(":")[2] if digest else None,
        "payload_bytes": None,
        "refers_to": bare(fields.get("warc-refers-to")),
        "payload": None,
    }


def records(file, size: int, compressed: bool, wanted, decode: bool, verify: bool) -> Iterator[dict]:
    """The rows of an open archive that ``wanted`` accepts by their headers."""
    file = _Window(file)
    at, plain = 0, None if compressed else _Plain(file, 0)
    while compressed and at < size or not compressed:
        stream = _Member(file, at) if compressed else plain
        head = stream.head()
        if not head:
            return
        fields = _fields(head)
        row, length = _row(fields), int(fields.get("content-length", 0))
        if wanted(row):
            left = length
            if fields.get("content-type", "").startswith("application/http"):
                http = stream.head()
                left -= len(http) + 4
                named = re.search(rb"(?i)^content-length:\s*(\d+)", http, re.M)
                row["payload_bytes"] = int(named[1]) if named else None
            if row["record_type"] != "revisit":
                row["payload_bytes"] = left
                if decode or verify:
                    payload = stream.read(left)
                    if len(payload) < left:
                        raise ValueError("a record is cut off")
                    left = 0
                    if verify and row["payload_digest"] is not None:
                        if hashlib.sha256(payload).hexdigest() != row["payload_digest"]:
                            raise ValueError(f"the payload of {row['record_id']} does not match its digest")
                    row["payload"] = payload if decode else None
            length = left
            yield row
        if compressed:
            at = stream.end()
        else:
            stream.skip(length)
            stream.close()


class _Files(InputPartition):
    def __init__(self, files: list[tuple[str, int]]):
        self.files = files


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.decode = options.get("payload", "decode") == "decode"
        self.verify = options.get("verify", "false") == "true"
        self.group = int(options.get("partitionbytes", FILE_BYTES))
        self.tests: list[tuple[str, frozenset | None, bool]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if name in HEADERS and isinstance(f, (EqualTo, In)):
                self.tests.append((name, frozenset([f.value] if isinstance(f, EqualTo) else f.value), False))
            elif name in HEADERS and isinstance(f, (IsNull, IsNotNull)):
                self.tests.append((name, None, isinstance(f, IsNull)))
            else:
                yield f

    def wanted(self, row: dict) -> bool:
        return all(
            row[name] in values if values is not None else (row[name] is None) == null
            for name, values, null in self.tests
        )

    def partitions(self) -> Sequence[InputPartition]:
        """Groups of files of about ``partitionbytes``; the manifests name them, or else the folder's archives."""
        at, root = store(self.path)
        info = at.get_file_info(root)
        if info.type == pafs.FileType.File:
            found = [(root, info.size)]
        else:
            inside = at.get_file_info(pafs.FileSelector(root, allow_not_found=True))
            manifests = sorted(x.path for x in inside if x.base_name.startswith("_manifest-"))
            found = []
            for m in manifests:
                with at.open_input_stream(m) as f:
                    found += [(f"{root}/{name}", size) for name, size in json.loads(f.read())]
            if not manifests:
                found = [(x.path, x.size) for x in inside if re.search(r"\.warc(\.gz)?$", x.base_name)]
        groups: list[list[tuple[str, int]]] = []
        held = 0
        for name, size in sorted(found):
            if not groups or held + size > self.group:
                groups.append([])
                held = 0
            groups[-1].append((name, size))
            held += size
        return [_Files(g) for g in groups] or [_Files([])]

    def read(self, partition: _Files) -> Iterator[pa.RecordBatch]:
        at, _ = store(self.path)
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        kinds = {"payload_bytes": pa.int64(), "payload": pa.binary()}
        held, size = [], 0

        def batch() -> pa.RecordBatch:
            columns = [pa.array([r[n] for r in held], kinds.get(n, pa.string())) for n in names]
            return pa.RecordBatch.from_arrays(columns, names=names)

        for name, length in partition.files:
            with at.open_input_file(name) as file:
                for row in records(file, length, name.endswith(".gz"), self.wanted, self.decode, self.verify):
                    held.append(row)
                    size += 200 + len(row["payload"] or b"")
                    if size > 4 << 20:
                        yield batch()
                        held, size = [], 0
        if held:
            yield batch()


class _Written(WriterCommitMessage):
    def __init__(self, files: list[tuple[str, int]]):
        self.files = files


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path = options["path"]
        self.file_bytes = int(options.get("filebytes", FILE_BYTES))
        self.overwrite = overwrite
        self.job = uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        at, root = store(self.path)
        at.create_dir(root, recursive=True)
        files: list[tuple[str, int]] = []
        out, size = None, 0
        for batch in iterator:
            for record in batch.to_pylist():
                if out is None:
                    name = f"part-{uuid.uuid4().hex}.warc.gz"
                    out, size = at.open_output_stream(f"{root}/{name}", compression=None), 0
                member = encode(record)
                out.write(member)
                size += len(member)
                if size >= self.file_bytes:
                    out.close()
                    files.append((name, size))
                    out = None
        if out is not None:
            out.close()
            files.append((name, size))
        return _Written(files)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        at, root = store(self.path)
        at.create_dir(root, recursive=True)
        if self.overwrite:
            for x in at.get_file_info(pafs.FileSelector(root)):
                if x.base_name.startswith("_manifest-"):
                    at.delete_file(x.path)
        listed = json.dumps([f for m in messages if m for f in m.files])
        with at.open_output_stream(f"{root}/_manifest-{self.job}.json") as f:
            f.write(listed.encode())

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        at, root = store(self.path)
        for m in messages:
            for name, _ in m.files if m else ():
                at.delete_file(f"{root}/{name}")


class WarcDataSource(DataSource):
    """The data source ``warc``; options: payload (decode or skip), verify, partitionBytes, fileBytes."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return WarcReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return WarcWriter(dict(self.options), overwrite)


def to_records(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """A record per row: a response, or a revisit of the equal payload with the smallest id.

    Payloads below ``REVISIT_BYTES`` are always responses, as are rows without an
    id where no row with one holds the same payload and rows that repeat the
    smallest id.
    """
    spark = pages.sparkSession
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("target_uri"), payload.alias("payload"))
    rows = rows.withColumns(
        {"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": F.sha2("payload", 256)}
    )
    firsts = materialize(
        rows.where(F.col("payload_bytes") >= REVISIT_BYTES)
        .groupBy("payload_digest")
        .agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .select("payload_digest", "first"),
        "warc-firsts",
    )
    joined = rows.join(sided(firsts), "payload_digest", "left")
    revisit = F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    urn = lambda c: F.concat(F.lit("urn:page:"), F.col(c).cast("string"))
    return joined.select(
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        urn("id").alias("record_id"),
        "target_uri",
        "payload_digest",
        "payload_bytes",
        F.when(revisit, urn("first")).alias("refers_to"),
        F.when(~revisit, F.col("payload")).alias("payload"),
    )


def write_archive(pages: DataFrame, path: str, **columns) -> None:
    """Write ``pages`` as WARC archives below ``path``."""
    spark = pages.sparkSession
    spark.dataSource.register(WarcDataSource)
    to_records(pages, **columns).write.format("warc").mode("append").save(qualified(spark, path))


def read_archive(spark: SparkSession, path: str, **options) -> DataFrame:
    """The records below ``path``."""
    spark.dataSource.register(WarcDataSource)
    return spark.read.format("warc").options(**options).load(qualified(spark, path))


def round_trip(pages: DataFrame, path: str) -> DataFrame:
    """Write ``pages``, read them back: one row per page.

    Revisits come from a reading of the headers of these records alone; of
    responses, which another reading decodes, size and digest are measured on
    the payload and held against the digest in the headers.
    """
    spark = pages.sparkSession
    write_archive(pages, path)
    number = lambda c: F.expr(f"try_cast(substr({c}, 10) AS bigint)").alias(c)

    def rows(back: DataFrame, size, digest) -> DataFrame:
        return back.select(
            number("record_id").alias("page_id"),
            size.alias("payload_bytes"),
            digest.alias("payload_digest"),
            "record_type",
            number("refers_to").alias("refers_to"),
            "target_uri",
        )

    revisits = read_archive(spark, path, payload="skip").where("record_type = 'revisit'")
    responses = read_archive(spark, path, verify="true").where("record_type = 'response'")
    return rows(responses, F.octet_length("payload").cast("long"), F.sha2("payload", 256)).union(
        rows(revisits, F.col("payload_bytes"), F.col("payload_digest"))
    )
