"""WARC archives: a writer and a PySpark data source.

The source plans a partition for each file, takes down filters on record types and header fields, and parses a record's
header before anything of its payload: a record that a filter leaves out is skipped over, one whose payload no column needs is
not decoded. Archives are plain (`.warc`) or have a gzip member for each record (`.warc.gz`). In both, what is left out is
skipped by seeking: members written here say in their gzip header how long they are (subfield `sl`: compressed and inflated
length), so of a skipped one no more than the record's header is inflated. Members without it are inflated and dropped.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualNullSafe, EqualTo, In, InputPartition, IsNotNull
from pyspark.sql.types import StructType

from granary.llm import kernels
from granary.llm.common import BROADCAST_ROWS, shared_dir, text_batches, written

SCHEMA = "record_id string, record_type string, target_uri string, date string, payload_digest string, refers_to string, content_length long, page_id long, payload_bytes long, headers map<string,string>, payload binary"
# Header fields of the columns.
FIELDS = {
    "record_id": "WARC-Record-ID", "record_type": "WARC-Type", "target_uri": "WARC-Target-URI", "date": "WARC-Date",
    "payload_digest": "WARC-Payload-Digest", "refers_to": "WARC-Refers-To", "content_length": "Content-Length",
    "page_id": "X-Page-ID", "payload_bytes": "X-Payload-Length",
}
NUMBERS = {"content_length", "page_id", "payload_bytes"}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Bytes read at once.
BLOCK = 1 << 18
#: Bytes of a gzip member inflated at once in search of a record's header.
HEAD = 1 << 10


def digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, payload_digest: str) -> str:
    """The same for the same page and payload, so that a revisit can name its response without a look at it."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{payload_digest}')}>"


def record(headers: dict[str, str], payload: bytes) -> bytes:
    """A record's bytes. A line break in a header's value would end it, so it becomes a space."""
    lines = "".join(f"{k}: {' '.join(v.splitlines())}\r\n" for k, v in headers.items())
    return f"WARC/1.1\r\n{lines}Content-Length: {len(payload)}\r\n\r\n".encode() + payload + b"\r\n\r\n"


def member(raw: bytes, level: int = 1) -> bytes:
    """raw as a gzip member whose header says how long it is (lengths beyond 32 bits are left out)."""
    stream = zlib.compressobj(level, wbits=-15)
    body = stream.compress(raw) + stream.flush()
    total = 24 + len(body) + 8
    said = total <= 0xFFFFFFFF and len(raw) <= 0xFFFFFFFF
    head = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff\x0c\0sl\x08\0" + struct.pack("<II", total, len(raw)) if said else b"\x1f\x8b\x08\0\0\0\0\0\0\xff"
    return head + body + struct.pack("<II", zlib.crc32(raw), len(raw) & 0xFFFFFFFF)


class Plain:
    """Records of a plain archive: the header's bytes first; then the payload is read or skipped."""

    def __init__(self, file, step: int = BLOCK):
        self.file, self.held, self.step = file, b"", step

    def head(self) -> bytes | None:
        while (end := self.held.find(b"\r\n\r\n")) < 0 or not self.held.lstrip(b"\r\n"):
            if end == 0:  # what ends a record
                self.held = self.held[4:]
                continue
            if not (more := self.file.read(self.step)):
                if self.held.strip(b"\r\n"):
                    raise ValueError("a record's header is cut off")
                return None
            self.held += more
        if end == 0:
            self.held = self.held[4:]
            return self.head()
        head, self.held = self.held[:end], self.held[end + 4 :]
        return head

    def skip(self, n: int) -> None:
        if n > len(self.held):
            self.file.seek(self.file.tell() + n - len(self.held))
            self.held = b""
        else:
            self.held = self.held[n:]

    def read(self, n: int) -> bytes:
        parts = [self.held[:n]]
        self.held, left = self.held[n:], n - len(parts[0])
        while left:
            if not (more := self.file.read(max(left, self.step))):
                raise ValueError("a record's payload is cut off")
            parts.append(more[:left])
            self.held = more[left:]
            left -= len(parts[-1])
        return b"".join(parts)


class Inflated:
    """What Plain needs of a file, over gzip members. Seeking forward jumps over members that say their length."""

    def __init__(self, file):
        self.file, self.held, self.offset, self.use = file, b"", 0, 0  # bytes of the file, where they begin, how many are used
        self.stream, self.at, self.inflated = None, 0, 0
        self.end: tuple[int, int] | None = None  # of the member: in the file, and inflated

    def _fill(self, least: int) -> int:
        """Holds so many unused bytes, if the file has them; how many there are."""
        while len(self.held) - self.use < least:
            if not (more := self.file.read(BLOCK)):
                break
            self.held, self.offset, self.use = self.held[self.use :] + more, self.offset + self.use, 0
        return len(self.held) - self.use

    def _begin(self) -> bool:
        """Whether there is another member; its header is looked at, not used."""
        if not self._fill(24):
            return False
        head = self.held[self.use : self.use + 24]
        self.stream, self.end = zlib.decompressobj(31), None
        if len(head) == 24 and head[3] & 4 and head[12:16] == b"sl\x08\0":
            total, size = struct.unpack_from("<II", head, 16)
            self.end = self.offset + self.use + total, self.at + size
        return True

    def read(self, n: int) -> bytes:
        while self.stream or self._begin():
            if not self._fill(1):
                return b""
            upto = min(len(self.held), self.end[0] - self.offset) if self.end else len(self.held)
            part = memoryview(self.held)[self.use : upto]
            out = self.stream.decompress(part, n)
            # at the end both may hold the bytes behind it
            self.use += len(part) - len(self.stream.unused_data if self.stream.eof else self.stream.unconsumed_tail)
            if self.stream.eof:
                self.stream = None
            if out:
                self.at += len(out)
                self.inflated += len(out)
                return out
        return b""

    def tell(self) -> int:
        return self.at

    def seek(self, to: int) -> None:
        while self.at < to and (self.stream or self._begin()):
            if self.end and to >= self.end[1]:
                place, self.at, self.stream = *self.end, None
                if place > self.offset + len(self.held):
                    self.file.seek(place)
                    self.held, self.offset, self.use = b"", place, 0
                else:
                    self.use = place - self.offset
            elif not self.read(min(BLOCK, to - self.at)):
                break


def parse(head: bytes) -> dict[str, str]:
    """A header's fields; names are compared without case, a line that begins with white space carries on the one before."""
    first, *lines = head.decode("utf-8", "replace").split("\r\n")
    if not first.strip().startswith("WARC/"):
        raise ValueError(f"not a WARC record: {first[:80]!r}")
    fields: dict[str, str] = {}
    name = None
    for line in lines:
        if line[:1] in (" ", "\t") and name:
            fields[name] += " " + line.strip()
        elif ":" in line:
            name, _, value = line.partition(":")
            name = name.strip().lower()
            fields[name] = value.strip()
    return fields


class File(InputPartition):
    def __init__(self, uri: str):
        self.uri = uri


class WarcReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict[str, str]):
        self.names, self.path = [f.name for f in schema.fields], options["path"]
        self.arrow = None
        self.schema = schema
        self.wanted: list[tuple[str, set]] = []

    def pushFilters(self, filters):
        """Equality and membership on header columns are tested on the header; the rest goes back to Spark."""
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if name in FIELDS and isinstance(f, EqualTo | EqualNullSafe) and f.value is not None:
                self.wanted.append((name, {f.value}))
            elif name in FIELDS and isinstance(f, In):
                self.wanted.append((name, set(f.value)))
            elif name in FIELDS and isinstance(f, IsNotNull):
                self.wanted.append((name, None))
            else:
                yield f

    def partitions(self):
        fs, root = pyarrow.fs.FileSystem.from_uri(self.path)
        prefix = self.path[: len(self.path.rstrip("/")) - len(root.rstrip("/"))]
        info = fs.get_file_info(root)
        found = [info] if info.is_file else fs.get_file_info(pyarrow.fs.FileSelector(root, recursive=True, allow_not_found=True))
        names = [prefix + x.path for x in sorted(found, key=lambda x: x.path) if x.is_file and x.base_name.endswith((".warc", ".warc.gz"))]
        return [File(name) for name in names or [""]]  # Spark wants a partition

    def records(self, uri: str) -> Iterator[tuple]:
        if not uri:
            return
        fs, path = pyarrow.fs.FileSystem.from_uri(uri)
        payload = "payload" in self.names
        with fs.open_input_file(path) as raw:
            archive = Plain(Inflated(raw), HEAD) if path.endswith(".gz") else Plain(raw)
            while (head := archive.head()) is not None:
                fields = parse(head)
                length = int(fields["content-length"])
                row = {c: fields.get(h.lower()) for c, h in FIELDS.items()}
                row |= {c: int(row[c]) if row[c] is not None else None for c in NUMBERS}
                if any(row[c] is None or (own is not None and row[c] not in own) for c, own in self.wanted):
                    archive.skip(length + 4)  # two line ends belong to every record
                    continue
                row["headers"] = fields
                if payload:
                    row["payload"] = archive.read(length)
                    if fields.get("warc-type") == "response" and (said := fields.get("warc-payload-digest", "")).startswith("sha1:") and said[5:] != digest(row["payload"]):
                        raise ValueError(f"the payload of {fields.get('warc-record-id')} is damaged")
                else:
                    archive.skip(length + 4)
                yield tuple(row[c] for c in self.names)

    def read(self, partition):
        from pyspark.sql.pandas.types import to_arrow_schema

        schema, rows, size = to_arrow_schema(self.schema), [], 0
        for row in self.records(partition.uri):
            rows.append(row)
            size += sum(len(x) for x in row if isinstance(x, bytes))
            if len(rows) == 1000 or size > BLOCK * 16:
                yield self._batch(rows, schema)
                rows, size = [], 0
        if rows:
            yield self._batch(rows, schema)

    @staticmethod
    def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
        columns = [pa.array([list(x.items()) if isinstance(x, dict) else x for x in c], f.type) for c, f in zip(zip(*rows), schema)]
        return pa.RecordBatch.from_arrays(columns, schema=schema)


class WarcSource(DataSource):
    """spark.read.format("warc").load(file or folder URI). Give a schema of fewer columns to leave payloads undecoded."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return WarcReader(schema, self.options)


def read_warc(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """The archives' records: all columns of SCHEMA, or those named. Damaged archives raise an error."""
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    reader = spark.read.format("warc")
    if columns:
        kinds = dict(x.strip().split(" ", 1) for x in SCHEMA.split(", "))
        reader = reader.schema(", ".join(f"{c} {kinds[c]}" for c in columns))
    return reader.load(path)


def write_warc(pages: DataFrame, folder: str | None = None, threshold: int = 0, compress: bool = True, level: int = 1) -> str:
    """A record for each page (page_id, url, html); the folder's URI.

    Of pages with equal payloads (html in UTF-8, null as empty) of at least threshold bytes, those with the largest page_id are
    response records and the others revisit records, which have no payload but the digest and the response's record. Smaller
    payloads are all responses. A null page_id is smaller than any other; where all of a group are null, all are responses.
    Repeated rows are a record each. A null url has no target. Empty table: no archive.

    Payloads are written whole, however long. Other columns are ignored, whatever their names. Only digests are grouped. Those
    with several pages go to the pages as a broadcast if a count shows that they are few; else revisits are found over page_id
    and digest alone and joined to the pages by both, so that a payload of very many pages is no hot key. Each task writes one
    archive under its attempt's name and moves it into place.
    """
    spark = pages.sparkSession
    text_batches(spark)
    folder = folder or shared_dir(spark, "warc")
    pages = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    own = F.unhex(F.sha1(F.col("html").cast("binary")))
    slim = pages.select("page_id", own.alias("sha"), F.octet_length("html").alias("size")).where(F.col("size") >= threshold)
    groups = written(slim.groupBy("sha").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"), "payloads")
    other = ~F.col("page_id").eqNullSafe(F.col("first"))
    if groups.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        rows = pages.withColumn("sha", own).join(F.broadcast(groups), "sha", "left").withColumn("refers_to", F.when(other, F.col("first")))
    else:
        revisits = slim.join(groups, "sha").where(other & F.col("first").isNotNull()).select(F.col("page_id").alias("_page"), F.col("sha").alias("_sha"), F.col("first").alias("refers_to")).distinct()
        rows = pages.withColumn("sha", own).join(revisits, F.col("page_id").eqNullSafe(F.col("_page")) & (F.col("sha") == F.col("_sha")), "left")
    rows = rows.select("page_id", "url", "refers_to", "html")

    def write(batches):
        out = trial = None
        n = 0
        task = TaskContext.get()
        for batch in batches:
            if out is None and batch.num_rows:
                fs, root = pyarrow.fs.FileSystem.from_uri(folder)
                fs.create_dir(root, recursive=True)
                trial = f"{root}/_{task.taskAttemptId()}.part"
                out = fs.open_output_stream(trial)
            for page_id, url, refers_to, html in zip(*(c.to_pylist() for c in batch.columns)):
                payload = html.encode()
                sha = digest(payload)
                headers = {"WARC-Type": "response" if refers_to is None else "revisit", "WARC-Record-ID": record_id(page_id, sha), "WARC-Date": "1970-01-01T00:00:00Z", "WARC-Payload-Digest": f"sha1:{sha}", "X-Payload-Length": str(len(payload))}
                if url is not None:
                    headers["WARC-Target-URI"] = url
                if page_id is not None:
                    headers["X-Page-ID"] = str(page_id)
                if refers_to is not None:
                    headers |= {"WARC-Refers-To": record_id(refers_to, sha), "WARC-Profile": REVISIT_PROFILE, "X-Refers-To-Page-ID": str(refers_to)}
                    payload = b""
                raw = record(headers, payload)
                out.write(member(raw, level) if compress else raw)
                n += 1
        if out is not None:
            out.close()
            name = f"{root}/part-{task.partitionId():06d}.warc{'.gz' if compress else ''}"
            fs.move(trial, name)
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64())], ["file", "n"])

    rows.mapInArrow(kernels.lean(write), "file string, n long").agg(F.sum("n")).first()
    return folder


def archived(spark: SparkSession, folder: str) -> DataFrame:
    """What the archives say of each page: header fields, and a response's length as its payload has it; digests are checked."""
    read = read_warc(spark, folder, ["page_id", "record_type", "payload_digest", "payload_bytes", "headers", "payload"])
    return read.select(
        "page_id", F.when(F.col("record_type") == "response", F.octet_length("payload")).otherwise(F.col("payload_bytes")).cast("long").alias("payload_bytes"),
        F.substring("payload_digest", 6, 32).alias("payload_digest"), "record_type", F.col("headers")["x-refers-to-page-id"].cast("long").alias("refers_to"),
    )
