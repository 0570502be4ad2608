"""WARC archives as a Python data source.

``spark.read.format("warc").load(folder)`` plans partitions from whole files (small ones share a
partition), takes predicates on the record type and other headers, and parses headers first: a
record that the predicates refuse is skipped without its block being decoded or kept (in plain
files by seeking past it). ``option("payload", "false")`` skips every block, and a list of record types
those of other types. Field names count without case, as the format has it; chunked and compressed
HTTP bodies are decoded (gzip and deflate; others are left as they are).

Writing makes gzip members a record and begins a new file every ``rollbytes``, so that no archive of
ours is a long task for a reader. Files get their final names when the job is committed, and what
failed or repeated attempts of the job have left is deleted then, or when it is aborted (an attempt
that still runs after that may leave a file whose name begins with an underscore, which readers skip).

``dedupe_and_write`` writes pages with revisit records for equal payloads, ``pages_back`` reads them.

Files are reached through pyarrow's file systems, so the folder may be local (shared) or remote.

Defined cases: see ``dedupe_and_write``. A folder without archives has no records; a record that breaks
off is an error. Payloads of any length are whole values, of which a batch holds 8 MB or one. Only id,
url and html of the pages are looked at, so names of other columns can't clash.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from snapdelta.llm.common import drop_written, join_spread, own_job, written

SCHEMA = "record_id string, record_type string, target_uri string, warc_date string, refers_to string, payload_digest string, content_length long, headers map<string,string>, payload binary"
NAMES = [c.split()[0] for c in SCHEMA.split(", ")]
#: Columns that stand for a header field.
FIELDS = {"record_id": "WARC-Record-ID", "record_type": "WARC-Type", "target_uri": "WARC-Target-URI", "warc_date": "WARC-Date", "refers_to": "WARC-Refers-To", "payload_digest": "WARC-Payload-Digest"}
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_CHUNK, _END = 1 << 20, b"\r\n\r\n"


def open_folder(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if ":" in path.split("/")[0] else (pafs.LocalFileSystem(), path)


class Blocks:
    """Bytes of a file, inflated member by member if it is gzipped; memory holds a chunk at a time."""

    def __init__(self, file: pa.NativeFile, zipped: bool):
        self.file, self.zipped, self.buffer = file, zipped, b""
        self.tool, self.raw = None, b""

    def _more(self) -> bool:
        if not self.zipped:
            data = self.file.read(_CHUNK)
        else:
            data = b""
            while not data:
                if self.tool is None or self.tool.eof:
                    self.raw = (self.tool.unused_data if self.tool else self.raw) or self.file.read(_CHUNK)
                    if not self.raw:
                        return False
                    self.tool = zlib.decompressobj(31)
                elif not self.raw:
                    self.raw = self.file.read(_CHUNK)
                    if not self.raw:
                        raise EOFError("a gzip member breaks off")
                data = self.tool.decompress(self.raw, _CHUNK)
                self.raw = self.tool.unconsumed_tail
        self.buffer += data
        return bool(data)

    def head(self) -> bytes | None:
        """The next record's header, or None at the end."""
        while (at := self.buffer.find(_END)) < 0:
            if not self._more():
                if self.buffer.strip():
                    raise EOFError("a record header breaks off")
                return None
        out, self.buffer = self.buffer[:at], self.buffer[at + 4 :]
        return out

    def take(self, n: int) -> bytes:
        parts, got = [self.buffer], len(self.buffer)
        while got < n:
            self.buffer = b""
            if not self._more():
                raise EOFError("a record block breaks off")
            parts.append(self.buffer)
            got += len(self.buffer)
        whole = b"".join(parts)
        self.buffer = whole[n:]
        return whole[:n]

    def skip(self, n: int) -> None:
        if not self.zipped and n > len(self.buffer):
            self.file.seek(n - len(self.buffer), 1)
            self.buffer = b""
            return
        while n > len(self.buffer):
            n -= len(self.buffer)
            self.buffer = b""
            if not self._more():
                raise EOFError("a record block breaks off")
        self.buffer = self.buffer[n:]


#: Field names as this module spells them, by their lower-case form.
_SPELLED = {n.lower(): n for n in (*FIELDS.values(), "Content-Type", "Content-Length", "WARC-Profile", "WARC-Truncated", "X-Page-Id", "X-Payload-Length", "X-Refers-To-Page-Id")}


def fields_of(lines: list[str]) -> dict[str, str]:
    """Fields with their customary spelling; of repeated ones the last counts."""
    out: dict[str, str] = {}
    name = ""
    for line in lines:
        if line[:1] in (" ", "\t") and name:
            out[name] += " " + line.strip()  # a folded line goes on with the last field
            continue
        name, colon, value = line.partition(":")
        name = _SPELLED.get(name.strip().lower(), name.strip())
        if colon:
            out[name] = value.strip()
        else:
            name = ""
    return out


def parse_head(head: bytes) -> dict[str, str]:
    version, *lines = head.decode("utf-8", "replace").lstrip("\r\n").split("\r\n")
    if not version.upper().startswith("WARC/"):
        raise ValueError(f"not a WARC record: {version[:40]!r}")
    return fields_of(lines)


def dechunked(body: bytes) -> bytes:
    """The chunks of a chunked body; from a chunk whose size makes no sense on, nothing."""
    parts, at = [], 0
    while (end := body.find(b"\r\n", at)) >= 0:
        try:
            size = int(body[at:end].partition(b";")[0].strip(), 16)
        except ValueError:
            break
        if size <= 0:
            break
        parts.append(body[end + 2 : end + 2 + size])
        at = end + 2 + size + 2
    return b"".join(parts)


def inflated(body: bytes, coding: str) -> bytes:
    """A gzip or deflate body; as it is if it can't be read or the coding is another."""
    kinds = {"gzip": (31,), "x-gzip": (31,), "deflate": (15, -15)}.get(coding, ())
    for bits in kinds:
        tool = zlib.decompressobj(bits)
        try:
            return tool.decompress(body) + tool.flush()
        except zlib.error:
            continue
    return body


def payload_of(block: bytes, headers: dict[str, str]) -> bytes:
    """What an HTTP message carries, without its codings, or the block itself."""
    if not headers.get("Content-Type", "").replace(" ", "").lower().startswith("application/http"):
        return block
    head, _, body = block.partition(_END)
    http = {k.lower(): v.lower() for k, v in fields_of(head.decode("latin-1").split("\r\n")[1:]).items()}
    if "chunked" in http.get("transfer-encoding", ""):
        body = dechunked(body)
    for coding in reversed([c.strip() for c in http.get("content-encoding", "").split(",") if c.strip()]):
        body = inflated(body, coding)
    return body


@dataclass
class Files(ds.InputPartition):
    paths: list[str]


class WarcReader(ds.DataSourceReader):
    def __init__(self, options: dict):
        self.path, asked = options["path"], options.get("payload", "true").lower()
        self.payload = asked == "true"
        self.payload_types = set() if asked in ("true", "false") else {t.strip() for t in asked.split(",")}
        self.share = int(options.get("partitionbytes", 64 << 20))
        self.tests: list[tuple[str, str, object]] = []

    def pushFilters(self, filters: list[ds.Filter]) -> Iterator[ds.Filter]:
        """Takes comparisons of header columns; Spark evaluates the rest."""
        for f in filters:
            column = f.attribute[0] if getattr(f, "attribute", None) and len(f.attribute) == 1 else None
            if column in FIELDS and isinstance(f, ds.EqualTo):
                self.tests.append((column, "in", {f.value}))
            elif column in FIELDS and isinstance(f, ds.In):
                self.tests.append((column, "in", set(f.value)))
            elif column in FIELDS and isinstance(f, ds.StringStartsWith):
                self.tests.append((column, "starts", f.value))
            elif column in FIELDS and isinstance(f, ds.IsNotNull):
                self.tests.append((column, "known", None))
            else:
                yield f

    def wanted(self, headers: dict[str, str]) -> bool:
        for column, kind, value in self.tests:
            found = headers.get(FIELDS[column])
            if found is None or kind == "in" and found not in value or kind == "starts" and not found.startswith(value):
                return False
        return True

    def partitions(self) -> list[Files]:
        system, path = open_folder(self.path)
        found = system.get_file_info(pafs.FileSelector(path, recursive=True))
        files = sorted((f for f in found if f.is_file and f.base_name.endswith((".warc", ".warc.gz")) and not f.base_name.startswith(("_", "."))), key=lambda f: f.path)
        out, held = [], 0
        for f in files:
            if not out or held + f.size > self.share:
                out.append(Files([]))
                held = 0
            out[-1].paths.append(f.path)
            held += f.size
        return out

    def read(self, partition: Files | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # a folder without archives
            return
        system, _ = open_folder(self.path)
        kinds = [pa.string()] * 6 + [pa.int64(), pa.map_(pa.string(), pa.string()), pa.binary()]
        names = NAMES
        rows: list[tuple] = []
        held = 0
        for path in partition.paths:
            with system.open_input_file(path) as file:
                blocks = Blocks(file, path.endswith(".gz"))
                while (head := blocks.head()) is not None:
                    headers = parse_head(head)
                    n, payload = int(headers.get("Content-Length", "0")), None
                    wanted = self.wanted(headers)
                    if wanted and (self.payload or headers.get("WARC-Type", "").lower() in self.payload_types):
                        payload = payload_of(blocks.take(n), headers)
                        blocks.skip(4)
                    else:
                        blocks.skip(n + 4)
                    if wanted:
                        rows.append((*(headers.get(FIELDS[c]) for c in names[:6]), n, list(headers.items()), payload))
                        held += len(payload or b"") + len(head)
                    if rows and (held > 8 << 20 or len(rows) >= 2000):
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                        rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


@dataclass
class Wrote(ds.WriterCommitMessage):
    paths: tuple[str, ...]


def record(row: dict) -> bytes:
    """A record's bytes: a response carries its payload in an HTTP message, a revisit only the headers."""
    payload, revisit = row["payload"], row["record_type"] == "revisit"
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" + (b"\r\n" if revisit else b"Content-Length: %d\r\n\r\n" % len(payload or b"") + (payload or b""))
    fields = {FIELDS[c]: row[c] for c in FIELDS}
    if revisit:
        fields["WARC-Profile"] = REVISIT
    fields |= dict(row["headers"] or [])
    fields |= {"Content-Type": "application/http; msgtype=response", "Content-Length": str(len(block))}
    clean = lambda v: str(v).replace("\r", "%0D").replace("\n", "%0A")
    head = "".join(f"{k}: {clean(v)}\r\n" for k, v in fields.items() if v is not None)
    return f"WARC/1.1\r\n{head}\r\n".encode() + block + _END


class WarcWriter(ds.DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path, self.zipped = options["path"], options.get("compression", "gzip") == "gzip"
        self.roll, self.job = int(options.get("rollbytes", 256 << 20)), uuid.uuid4().hex
        if overwrite:
            raise ValueError("WARC folders are only appended to")

    def write(self, batches: Iterator[pa.RecordBatch]) -> Wrote:
        system, folder = open_folder(self.path)
        system.create_dir(folder, recursive=True)
        attempt = f"{folder}/_task-{self.job}-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex[:12]}"
        names, file, held = [], None, 0
        for batch in batches:
            for k in range(batch.num_rows):  # a row at a time: a batch's payloads are never all Python objects
                data = record(batch.slice(k, 1).to_pylist()[0])
                if self.zipped:
                    tool = zlib.compressobj(1, zlib.DEFLATED, 31)
                    data = tool.compress(data) + tool.flush()
                if file is None or held + len(data) > self.roll and held:
                    if file:
                        file.close()
                    names.append(f"{attempt}-{len(names):04d}.warc" + ".gz" * self.zipped)
                    file, held = system.open_output_stream(names[-1], compression=None), 0
                file.write(data)
                held += len(data)
        if file:
            file.close()
        return Wrote(tuple(names))

    def _clear(self) -> None:
        system, folder = open_folder(self.path)
        for f in system.get_file_info(pafs.FileSelector(folder, allow_not_found=True)):
            if f.base_name.startswith(f"_task-{self.job}-"):
                system.delete_file(f.path)

    def commit(self, messages: list[Wrote | None]) -> None:
        system, folder = open_folder(self.path)
        system.create_dir(folder, recursive=True)
        paths = [p for m in messages if m for p in m.paths]
        with ThreadPoolExecutor(16) as pool:  # a name costs a request each in an object store
            list(pool.map(lambda p: system.move(p, p.replace("/_task-", "/part-")), paths))
        self._clear()

    def abort(self, messages: list[Wrote | None]) -> None:
        self._clear()


class WarcDataSource(ds.DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WarcDataSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def read_warc(spark: SparkSession, folder: str, payload: bool | str = True) -> DataFrame:
    """``payload``: whether blocks are decoded, or the record types (separated by commas) whose blocks are."""
    register(spark)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(folder)


def write_warc(df: DataFrame, folder: str, compression: str = "gzip", roll_bytes: int = 256 << 20) -> None:
    register(df.sparkSession)
    with own_job(df.sparkSession):
        df.select(*NAMES).write.format("warc").mode("append").option("compression", compression).option("rollbytes", str(roll_bytes)).save(folder)


def _uri(key: Column) -> Column:
    """A record's id from its page's, so that a revisit can name a record that another task writes."""
    digest = F.md5(F.concat(F.lit("page:"), F.coalesce(key.cast("string"), F.lit("null"))))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(digest, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))


def dedupe_and_write(pages: DataFrame, folder: str, id_col: str = "page_id", url: str = "url", html: str = "html", least: int = 100, date: str = "1970-01-01T00:00:00Z", compression: str = "gzip") -> None:
    """Writes a record a page: of equal payloads of ``least`` bytes or more only the smallest id's is a response.

    Null html is an empty payload. Repeated rows of the smallest id are responses each; a page with
    a null id revisits the smallest id there is, and is a response where there is none. Ids may have any
    type that has an order; null ones are told from empty ones.

    Who revisits whom is found on (id, digest) alone, and only payloads that occur twice take part: a
    digest's pages are counted before anything is dealt, and very frequent digests are spread. Payloads
    are dealt out once, by id and digest, which no group of copies shares.
    """
    spark = pages.sparkSession
    body = F.coalesce(F.col(html), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).alias("id"), F.col(url).alias("target_uri"), body.alias("body")).withColumn("digest", F.sha2("body", 256))
    known = rows.where(F.octet_length("body") >= least).select("id", "digest")
    groups = written(known.groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1 AND first IS NOT NULL"), "warc-groups")
    copies = join_spread(known, groups.drop("n"), "digest", groups.select("digest", "n")).where(~F.col("id").eqNullSafe(F.col("first"))).distinct()
    revisits = copies.select(F.col("id").alias("__id"), F.col("digest").alias("__digest"), "first")
    seen = rows.join(revisits, F.col("id").eqNullSafe(F.col("__id")) & (F.col("digest") == F.col("__digest")), "left")
    revisit = F.col("__digest").isNotNull()
    named = lambda c: F.url_encode(F.col(c).cast("string"))  # noqa: E731  no line break, no space at an end
    extra = F.map_filter(F.create_map(F.lit("X-Page-Id"), named("id"), F.lit("X-Payload-Length"), F.octet_length("body").cast("string"), F.lit("X-Refers-To-Page-Id"), F.when(revisit, named("first"))), lambda _, v: v.isNotNull())
    write_warc(seen.select(
        _uri(F.col("id")).alias("record_id"), F.when(revisit, "revisit").otherwise("response").alias("record_type"), "target_uri", F.lit(date).alias("warc_date"),
        F.when(revisit, _uri(F.col("first"))).alias("refers_to"), F.concat(F.lit("sha256:"), "digest").alias("payload_digest"), F.lit(0).cast("long").alias("content_length"),
        extra.alias("headers"), F.when(~revisit, F.col("body")).alias("payload"),
    ), folder, compression)
    drop_written(groups)


def pages_back(spark: SparkSession, folder: str, id_type: str = "bigint") -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) from an archive that ``dedupe_and_write`` made.

    One scan: responses are measured by their payload as read, revisits by their headers, without their
    blocks being decoded. ``id_type`` is that of the ids that were written.
    """
    field = lambda name: F.element_at("headers", name)
    key = lambda name: F.url_decode(field(name)).cast(id_type)
    own = F.col("record_type") == "response"
    return read_warc(spark, folder, "response").where("record_type in ('response', 'revisit')").select(
        key("X-Page-Id").alias("page_id"), F.when(own, F.octet_length("payload")).otherwise(field("X-Payload-Length").cast("int")).cast("long").alias("payload_bytes"),
        F.when(own, F.sha2("payload", 256)).otherwise(F.replace("payload_digest", F.lit("sha256:"), F.lit(""))).alias("payload_digest"), "record_type", key("X-Refers-To-Page-Id").alias("refers_to"))


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha256(coalesce(html, '')) AS digest FROM pages),
g AS (SELECT digest, min(page_id) AS first FROM p WHERE strlen(body) >= 100 GROUP BY digest HAVING count(*) > 1)
SELECT page_id, strlen(body)::BIGINT AS payload_bytes, p.digest AS payload_digest,
  CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM p LEFT JOIN g ON p.digest = g.digest
"""
