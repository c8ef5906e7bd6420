"""WARC archives as a PySpark data source ("warc"), read and written.

Reading: files are listed and packed into partitions on the driver. Predicates on the record type and the named
header columns are pushed to the source. A record's header is parsed first; a record that fails a predicate has its
payload skipped, by a seek in plain files and by discarding inflated blocks in compressed ones, and is never decoded.

Writing: every task writes whole files under a hidden name and the commit renames them, so lost or repeated tasks
leave nothing behind. Each record is a gzip member of its own, as is usual for .warc.gz.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, StringContains, StringEndsWith, StringStartsWith, WriterCommitMessage

from ._common import scratch, small_batches

#: Columns of a read record; payload_bytes and payload_sha1 (base32) are of the payload as read. The header columns are those that predicates are pushed to.
SCHEMA = "file string, offset long, warc_type string, record_id string, target_uri string, date string, content_type string, payload_digest string, refers_to string, content_length long, headers map<string,string>, http_headers map<string,string>, payload_bytes long, payload_sha1 string, payload binary"
HEADER_COLUMNS = {"warc_type": "warc-type", "record_id": "warc-record-id", "target_uri": "warc-target-uri", "date": "warc-date", "content_type": "content-type", "payload_digest": "warc-payload-digest", "refers_to": "warc-refers-to"}
#: Columns of a record to write; payload is the block, http_headers (or null) is put before it as an HTTP response.
WRITE_SCHEMA = "warc_type string, record_id string, target_uri string, date string, content_type string, payload_digest string, refers_to string, headers map<string,string>, http_headers map<string,string>, payload binary"
CHUNK = 1 << 16
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def open_fs(path: str):
    """(file system, path in it) of a URI or local path."""
    from pyarrow import fs

    path = re.sub(r"^file:/+", "/", path)
    return (fs.LocalFileSystem(), path) if path.startswith("/") else fs.FileSystem.from_uri(path)


class _Plain:
    """Record blocks of an uncompressed file."""

    def __init__(self, f):
        self.f, self.rest = f, b""
        self.at = 0

    def offset(self) -> int:
        return self.at - len(self.rest)

    def _more(self) -> bool:
        b = self.f.read(CHUNK)
        self.at += len(b)
        self.rest += b
        return bool(b)

    def header(self) -> bytes | None:
        while True:
            self.rest = self.rest.lstrip(b"\r\n")
            end = self.rest.find(b"\r\n\r\n")
            if end >= 0:
                out, self.rest = self.rest[:end], self.rest[end + 4 :]
                return out
            if not self._more():
                if self.rest.strip():
                    raise ValueError("a WARC file ends within a header")
                return None

    def block(self, n: int) -> bytes:
        while len(self.rest) < n:
            if not self._more():
                raise ValueError("a WARC file ends within a record")
        out, self.rest = self.rest[:n], self.rest[n:]
        return out

    def skip(self, n: int) -> None:
        if n <= len(self.rest):
            self.rest = self.rest[n:]
            return
        to = self.offset() + n
        if to > self.f.size():
            raise ValueError("a WARC file ends within a record")
        self.f.seek(to)
        self.at, self.rest = to, b""


class _Gzip(_Plain):
    """The same of a file of gzip members."""

    def __init__(self, f):
        super().__init__(f)
        self.raw, self.z, self.within = b"", zlib.decompressobj(31), False
        self.member, self.next_member = 0, 0

    def offset(self) -> int:
        return self.member

    def _more(self) -> bool:
        while True:
            if self.z.eof:
                self.raw, self.within = self.z.unused_data, False
                self.next_member = self.at - len(self.raw)
                self.z = zlib.decompressobj(31)
            if not self.raw:
                self.raw = self.f.read(CHUNK)
                self.at += len(self.raw)
                if not self.raw:
                    if self.within:
                        raise ValueError("a WARC file ends within a gzip member")
                    return False
            got, self.within = self.z.decompress(self.raw, 4 * CHUNK), True
            self.raw = self.z.unconsumed_tail
            if got:
                self.rest += got
                return True

    def header(self) -> bytes | None:
        out = super().header()
        self.member = self.next_member
        return out

    def skip(self, n: int) -> None:
        while n > len(self.rest):
            n -= len(self.rest)
            self.rest = b""
            if not self._more():
                raise ValueError("a WARC file ends within a record")
        self.rest = self.rest[n:]


def parse_header(block: bytes) -> tuple[str, dict[str, str]]:
    """(first line, fields by lower-case name); later fields of a name win, folded lines continue."""
    lines = re.sub(rb"\r\n[ \t]+", b" ", block).split(b"\r\n")
    fields = {}
    for line in lines[1:]:
        k, colon, v = line.partition(b":")
        if colon:
            fields[k.strip().lower().decode("utf-8", "replace")] = v.strip().decode("utf-8", "replace")
    return lines[0].decode("utf-8", "replace"), fields


def _wanted(f: Filter, fields: dict[str, str]) -> bool:
    v = fields.get(HEADER_COLUMNS[f.attribute[0]])
    if isinstance(f, IsNotNull):
        return v is not None
    if v is None:
        return False
    if isinstance(f, EqualTo):
        return v == f.value
    if isinstance(f, In):
        return v in f.value
    return v.startswith(f.value) if isinstance(f, StringStartsWith) else v.endswith(f.value) if isinstance(f, StringEndsWith) else f.value in v


@dataclass
class FileSpan(InputPartition):
    files: tuple[str, ...]


class WarcReader(DataSourceReader):
    PUSHED = (EqualTo, In, IsNotNull, StringStartsWith, StringEndsWith, StringContains)

    def __init__(self, options):
        self.path = options["path"]
        self.payloads = options.get("payloads", "true").lower()
        self.partition_bytes = int(options.get("partitionBytes", 32 << 20))
        self.filters: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if isinstance(f, self.PUSHED) and len(f.attribute) == 1 and f.attribute[0] in HEADER_COLUMNS:
                self.filters.append(f)
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        """Files, large ones first, packed up to partitionBytes each."""
        from pyarrow import fs

        store, path = open_fs(self.path)
        infos = [store.get_file_info(path)] if store.get_file_info(path).type == fs.FileType.File else store.get_file_info(fs.FileSelector(path, recursive=True))
        files = sorted(((i.size, i.path) for i in infos if i.type == fs.FileType.File and re.search(r"\.warc(\.gz)?$", i.path) and not i.base_name.startswith((".", "_"))), reverse=True)
        out, now, size = [], [], 0
        for n, p in files:
            if now and size + n > self.partition_bytes:
                out.append(FileSpan(tuple(now)))
                now, size = [], 0
            now.append(p)
            size += n
        return out + [FileSpan(tuple(now))]

    def read(self, partition: FileSpan) -> Iterator[pa.RecordBatch]:
        schema = _arrow_schema(SCHEMA)
        rows, size = [], 0
        store, _ = open_fs(self.path)
        for path in partition.files:
            with store.open_input_file(path) as f:
                for row in self._records(path, f):
                    rows.append(row)
                    size += len(row[-1] or b"") + 1000
                    if size > 4 << 20:
                        yield _batch(rows, schema)
                        rows, size = [], 0
        if rows:
            yield _batch(rows, schema)

    def _records(self, path: str, f) -> Iterator[tuple]:
        source = _Gzip(f) if path.endswith(".gz") else _Plain(f)
        while True:
            at = source.offset()
            head = source.header()
            if head is None:
                return
            if isinstance(source, _Gzip):
                at = source.offset()
            version, fields = parse_header(head)
            if not version.startswith("WARC/"):
                raise ValueError(f"{path}: no WARC record at {at}")
            n = int(fields.get("content-length", 0))
            if not all(_wanted(p, fields) for p in self.filters):
                source.skip(n)
                continue
            http, payload = None, None
            if fields.get("content-type", "").startswith("application/http"):
                block = source.block(n)
                head, _, payload = block.partition(b"\r\n\r\n")
                http = parse_header(head)[1]
            elif self.payloads != "false":
                payload = source.block(n)
            else:
                source.skip(n)
            size = sha1 = None
            if self.payloads != "false":
                size, sha1 = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()
            yield (path, at, *(fields.get(h) for h in HEADER_COLUMNS.values()), n, list(fields.items()), None if http is None else list(http.items()), size, sha1, payload if self.payloads == "true" else None)


def _arrow_schema(ddl: str) -> pa.Schema:
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary(), "map<string,string>": pa.map_(pa.string(), pa.string())}
    return pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in re.split(r", ", ddl)])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), schema.types)], schema=schema)


@dataclass
class Written(WriterCommitMessage):
    files: tuple[str, ...]


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options, overwrite: bool):
        self.path, self.overwrite = options["path"], overwrite
        self.gzip = options.get("compression", "gzip") == "gzip"
        self.level = int(options.get("level", 6))
        self.file_bytes = int(options.get("fileBytes", 128 << 20))

    def record(self, row: dict) -> bytes:
        http = row.get("http_headers")
        block = row["payload"] or b""
        if http is not None:
            block = b"HTTP/1.1 200 OK\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in http) + b"\r\n" + block
        fields = [("WARC-Type", row["warc_type"]), ("WARC-Record-ID", row["record_id"]), ("WARC-Date", row["date"]), ("WARC-Target-URI", row["target_uri"]), ("WARC-Payload-Digest", row["payload_digest"]), ("WARC-Refers-To", row["refers_to"]), *(row["headers"] or []), ("Content-Type", row["content_type"]), ("Content-Length", str(len(block)))]
        clean = lambda v: re.sub(r"[\r\n]+", " ", v)
        head = b"WARC/1.1\r\n" + b"".join(f"{k}: {clean(v)}\r\n".encode("utf-8", "replace") for k, v in fields if v is not None)
        return head + b"\r\n" + block + b"\r\n\r\n"

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        store, path = open_fs(self.path)
        store.create_dir(path, recursive=True)
        context = TaskContext.get()
        stem = f"{context.partitionId() if context else 0:05d}-{uuid.uuid4().hex[:12]}"
        files: list[str] = []
        out, size = None, 0
        try:
            for b in batches:
                for row in b.to_pylist():
                    if out is None or size > self.file_bytes:
                        if out is not None:
                            out.close()
                        files.append(f"{path}/.{stem}-{len(files)}.warc" + ".gz" * self.gzip)
                        out, size = store.open_output_stream(files[-1], compression=None), 0
                    data = self.record(row)
                    if self.gzip:
                        z = zlib.compressobj(self.level, zlib.DEFLATED, 31)
                        data = z.compress(data) + z.flush()
                    out.write(data)
                    size += len(data)
        finally:
            if out is not None:
                out.close()
        return Written(tuple(files))

    def commit(self, messages: list[Written | None]) -> None:
        """The files of the tasks that counted get their names, on the driver; with overwrite, older ones go."""
        from pyarrow import fs

        store, path = open_fs(self.path)
        store.create_dir(path, recursive=True)
        keep = {f for m in messages if m for f in m.files}
        for i in store.get_file_info(fs.FileSelector(path)):
            if i.path not in keep and self.overwrite and ".warc" in i.base_name:
                store.delete_file(i.path)
        for f in keep:
            folder, _, name = f.rpartition("/")
            store.move(f, f"{folder}/{name.removeprefix('.')}")

    def abort(self, messages: list[Written | None]) -> None:
        store, _ = open_fs(self.path)
        for f in (f for m in messages if m for f in m.files):
            store.delete_file(f)


class WarcDataSource(DataSource):
    """spark.read.format("warc").load(path) and df.write.format("warc").save(path).

    Read options: payloads (true; digest: only their length and SHA-1 are returned; false: none is decoded), partitionBytes. Write options: compression (gzip or none), level, fileBytes.
    """

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
    small_batches(spark)


def base32(digits):
    """Column: upper-case base32 of a column of 40 hex digits; five bits from each pair of neighbouring digits."""
    nibble = lambda at: F.instr(F.lit("0123456789abcdef"), F.substr(digits, at + 1, F.lit(1))) - 1

    def letter(i: int):
        at, shift = F.lit(5 * i // 4), 3 - 5 * i % 4
        bits = F.shiftright(nibble(at) * 16 + nibble(at + 1), shift).bitwiseAND(F.lit(31))
        return F.substr(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"), bits + 1, F.lit(1))

    return F.concat(*[letter(i) for i in range(32)])


def page_records(pages: DataFrame, payload_col: str = "html", id_col: str = "page_id", uri_col: str = "url", min_bytes: int = 0, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """One record to write for each row: a response, or a revisit of the first record (smallest id) with an equal payload.

    Payloads under min_bytes are all responses. Equality goes by SHA-1. A null payload is empty; a null id sorts last
    and is a revisit wherever any row with an id has its payload; rows that tie on the smallest id are all responses.
    Repeated payloads are found by an aggregation of digests alone, and only a digest that repeats takes part in the join.
    """
    p = pages.select(F.col(id_col).alias("id"), F.col(uri_col).alias("uri"), F.coalesce(F.encode(F.col(payload_col), "UTF-8"), F.lit(b"")).alias("payload"))
    p = p.withColumns({"sha": F.sha1("payload"), "size": F.octet_length("payload").cast("long")})
    again = p.where(F.col("size") >= min_bytes).groupBy("sha").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1 and first is not null").select("sha", "first")
    j = p.join(again, "sha", "left")
    revisit = (F.col("size") >= min_bytes) & F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    pair = lambda k, v: F.create_map(F.lit(k), v)
    return j.select(
        F.when(revisit, "revisit").otherwise("response").alias("warc_type"),
        urn(F.col("id")).alias("record_id"),
        F.col("uri").alias("target_uri"),
        F.lit(date).alias("date"),
        F.lit("application/http; msgtype=response").alias("content_type"),
        F.concat(F.lit("sha1:"), base32(F.col("sha"))).alias("payload_digest"),
        F.when(revisit, urn(F.col("first"))).alias("refers_to"),
        F.when(revisit, pair("WARC-Profile", F.lit(REVISIT))).alias("headers"),
        F.create_map(F.lit("Content-Type"), F.lit("text/html; charset=utf-8"), F.lit("Content-Length"), F.col("size").cast("string")).alias("http_headers"),
        F.when(revisit, F.lit(b"")).otherwise(F.col("payload")).alias("payload"),
    )


def write_pages(pages: DataFrame, path: str, **kw) -> None:
    register(pages.sparkSession)
    page_records(pages, **kw).write.format("warc").mode("append").save(path)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to and target_uri of each response and revisit.

    Length and digest of a response are those of the payload as read back; a revisit has them in its headers.
    """
    register(spark)
    r = spark.read.format("warc").option("payloads", "digest").load(path).where(F.col("warc_type").isin("response", "revisit"))
    full = F.col("warc_type") == "response"
    return r.select(
        F.expr("try_cast(nullif(regexp_extract(record_id, '^<urn:page:(-?[0-9]+)>$', 1), '') as bigint)").alias("page_id"),
        F.when(full, F.col("payload_bytes")).otherwise(F.col("http_headers")["content-length"].cast("long")).alias("payload_bytes"),
        F.when(full, F.col("payload_sha1")).otherwise(F.regexp_replace("payload_digest", "^sha1:", "")).alias("payload_digest"),
        F.col("warc_type").alias("record_type"),
        F.expr("try_cast(nullif(regexp_extract(refers_to, '^<urn:page:(-?[0-9]+)>$', 1), '') as bigint)").alias("refers_to"),
        "target_uri",
    )


def round_trip(pages: DataFrame, **kw) -> DataFrame:
    """Writes pages to archives in the shared folder and reads them back."""
    path = scratch(pages.sparkSession, "warc")
    write_pages(pages, path, **kw)
    return read_pages(pages.sparkSession, path)
