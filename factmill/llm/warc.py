"""WARC archives as a PySpark Python data source, for reading and writing.

Writing: each task writes archives of bounded size, one gzip member per record, and the driver then publishes their names
in a manifest, so what failed or repeated tasks leave behind is never read. The manifest also has places at which an
archive can be parted. A member carries its own length in a gzip extra field. Reading: the driver plans the files, or
parts of them, into partitions by size and takes over predicates on the columns that come from record headers; a task inflates only the start of a member, parses the headers, tests the predicates, and
goes to the next member by its length, so payloads that are not wanted are never inflated. Archives of other programs
(plain, or with members without the extra field) are read too. Files are opened through pyarrow's file systems, so a path
may be a local one or a URI.

Columns: record_id, record_type, target_uri, date, content_type, payload_digest, refers_to string, payload_bytes long,
payload binary (null unless the option payload is true, and for records without one).

Defined results: a null payload is an empty one; an empty table makes an empty archive; repeated rows are separate
records; ids and URIs lose line breaks and control characters, which headers cannot hold.
"""

from __future__ import annotations

import json
import posixpath
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, IsNotNull, IsNull, StringContains, StringEndsWith, StringStartsWith, WriterCommitMessage

from factmill.llm.common import bound_batches, cut, file_system, read, shared_path, slot

SCHEMA = "record_id string, record_type string, target_uri string, date string, content_type string, payload_digest string, refers_to string, payload_bytes long, payload binary"
_TYPES = pa.schema([(c.split()[0], {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[c.split()[1]]) for c in SCHEMA.split(", ")])
_HEADERS = {
    "record_id": "WARC-Record-ID", "record_type": "WARC-Type", "target_uri": "WARC-Target-URI", "date": "WARC-Date", "content_type": "Content-Type",
    "payload_digest": "WARC-Payload-Digest", "refers_to": "WARC-Refers-To", "payload_bytes": "X-Payload-Length",
}
FILE_BYTES = 256 << 20
PARTITION_BYTES = 64 << 20
#: Bytes between the places at which an archive can be parted.
CUT_BYTES = 1 << 20
BATCH_BYTES = 8 << 20
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_CONTROL = re.compile(r"[\x00-\x1f\x7f]+")


# --- records


def record(row: dict) -> bytes:
    """A record of WARC/1.1; the block is an HTTP response, without a body if the record revisits another."""
    payload = row.get("payload") or b""
    revisit = row.get("record_type") == "revisit"
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + (b"" if revisit else payload)
    lines = ["WARC/1.1"]
    values = row | {"content_type": row.get("content_type") or "application/http; msgtype=response", "payload_bytes": row.get("payload_bytes")}
    for column, name in _HEADERS.items():
        if (v := values.get(column)) is not None:
            lines.append(f"{name}: {_CONTROL.sub(' ', str(v))}")
    if revisit:
        lines.append(f"WARC-Profile: {REVISIT_PROFILE}")
    lines += [f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def member(raw: bytes, level: int = 1) -> bytes:
    """A gzip member that carries its own length in an extra field."""
    z = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = z.compress(raw) + z.flush()
    tail = struct.pack("<II", zlib.crc32(raw), len(raw) & 0xFFFFFFFF)
    return b"\x1f\x8b\x08\x04\0\0\0\0\x04\xff" + struct.pack("<HccHI", 8, b"F", b"M", 4, 20 + len(body) + 8) + body + tail


def parse_headers(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    out: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if colon:
            out.setdefault(name.strip().lower(), value.strip())
    return out


def row_of(headers: dict[str, str]) -> dict:
    row = {c: headers.get(h.lower()) for c, h in _HEADERS.items()}
    n = row["payload_bytes"]
    row["payload_bytes"] = int(n) if n and n.isdigit() else None
    return row | {"payload": None}


def payload_of(headers: dict[str, str], block: bytes) -> bytes | None:
    if headers.get("warc-type") == "revisit":
        return None
    return block.partition(b"\r\n\r\n")[2] if headers.get("content-type", "").startswith("application/http") else block


class _Window:
    """Bytes of a file from a place on, read in steps."""

    def __init__(self, f, step: int = 1 << 20):
        self.f, self.step, self.at, self.data = f, step, 0, b""

    def need(self, n: int) -> bool:
        while len(self.data) < n:
            more = self.f.read(max(self.step, n - len(self.data)))
            if not more:
                return False
            self.data += more
        return True

    def more(self) -> bool:
        """Read on, as much as is held already, so that what grows is copied a bounded number of times; False at the end."""
        had = len(self.data)
        self.need(had + max(self.step, had))
        return len(self.data) > had

    def drop(self, n: int) -> None:
        if n <= len(self.data):
            self.data = self.data[n:]
        else:
            self.f.seek(self.f.tell() + n - len(self.data))
            self.data = b""
        self.at += n


def _inflated(w: _Window, keep: bool) -> tuple[bytes, int]:
    """The content of the member at the window's start (nothing, unless it is kept) and the member's length. Every byte is
    inflated once, in bounded steps."""
    z, parts, used = zlib.decompressobj(31), [], 0
    while not z.eof:
        if used == len(w.data) and not w.more():
            raise ValueError("an archive ends within a record")
        step = w.data[used : used + (1 << 18)]
        got = z.decompress(step)
        used += len(step)
        if keep:
            parts.append(got)
    return b"".join(parts), used - len(z.unused_data)


def _length(data: bytes) -> int | None:
    """A member's length, if it carries one."""
    if len(data) >= 20 and data[3] & 4 and data[12:14] == b"FM":
        return struct.unpack("<I", data[16:20])[0]
    return None


def records(f, packed: bool, wanted, payload: bool, size: int | None = None) -> Iterator[dict]:
    """Rows of the records whose headers pass wanted(row); payloads are inflated only for those, and only if asked for.
    size: no record that begins so many bytes after the file's place, or later, is read."""
    w = _Window(f)
    while (size is None or w.at < size) and w.need(1):
        if packed:
            w.need(20)
            n = _length(w.data)
            if n is not None and not w.need(min(n, 1 << 16)):
                raise ValueError("an archive ends within a record")
            z = zlib.decompressobj(31)
            raw = z.decompress(w.data, 1 << 13)
            while b"\r\n\r\n" not in raw and not z.eof:
                if not z.unconsumed_tail and not w.more():
                    raise ValueError("an archive ends within a record")
                z = zlib.decompressobj(31)
                raw = z.decompress(w.data, 2 * len(raw) + (1 << 13))
            head, _, _ = raw.partition(b"\r\n\r\n")
            headers = parse_headers(head)
            row = row_of(headers)
            take = wanted(row)
            if n is None or (take and payload):
                if n is not None:
                    w.need(n)
                raw, n = _inflated(w, take and payload)
            if take:
                if payload:
                    block = int(headers.get("content-length", "0"))
                    row["payload"] = payload_of(headers, raw[len(head) + 4 : len(head) + 4 + block])
                yield row
            w.drop(n)
        else:
            while b"\r\n\r\n" not in w.data:
                if not w.more():
                    if w.data.strip():
                        raise ValueError("an archive ends within a record")
                    return
            head = w.data.partition(b"\r\n\r\n")[0]
            headers = parse_headers(head.lstrip(b"\r\n"))
            block, row = int(headers.get("content-length", "0")), row_of(headers)
            w.drop(len(head) + 4)
            if wanted(row):
                if payload:
                    w.need(block)
                    row["payload"] = payload_of(headers, w.data[:block])
                yield row
            w.drop(block + 4)


# --- the data source


@dataclass
class _Files(InputPartition):
    """Files with the places from and to which they are read."""

    parts: tuple[tuple[str, int, int], ...]


@dataclass
class _Written(WriterCommitMessage):
    """Archives, each with the places at which it can be parted."""

    files: dict[str, list[int]]


def _test(f):
    """A predicate on rows for a pushed filter, or None if the filter is not one on headers."""
    name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
    if name not in _HEADERS or name == "payload":
        return None
    if isinstance(f, EqualTo):
        return lambda r: r[name] == f.value
    if isinstance(f, In):
        values = set(f.value)
        return lambda r: r[name] in values
    if isinstance(f, IsNull):
        return lambda r: r[name] is None
    if isinstance(f, IsNotNull):
        return lambda r: r[name] is not None
    if isinstance(f, StringStartsWith):
        return lambda r: r[name] is not None and r[name].startswith(f.value)
    if isinstance(f, StringEndsWith):
        return lambda r: r[name] is not None and r[name].endswith(f.value)
    if isinstance(f, StringContains):
        return lambda r: r[name] is not None and f.value in r[name]
    return None


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.payload = options["path"], str(options.get("payload", "false")).lower() == "true"
        self.most = int(options.get("partitionbytes", options.get("partitionBytes", PARTITION_BYTES)))
        self.filters: list = []

    def pushFilters(self, filters):
        for f in filters:
            if _test(f) is None:
                yield f
            else:
                self.filters.append(f)

    def partitions(self) -> list[InputPartition]:
        system, base = file_system(self.path)
        info = [system.get_file_info(base)]
        cuts: dict[str, list[int]] = {}
        if info[0].type == pafs.FileType.Directory:
            info = [i for i in system.get_file_info(pafs.FileSelector(base)) if i.is_file]
            lists = [i for i in info if i.base_name.startswith("_manifest-")]
            if lists:
                for i in lists:
                    with system.open_input_stream(i.path) as f:
                        cuts |= json.loads(f.read())
                info = [i for i in info if i.base_name in cuts]
            info = [i for i in info if i.base_name.endswith((".warc", ".warc.gz"))]
        elif info[0].type == pafs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        ranges = []
        for i in info:
            places = [0, *cuts.get(i.base_name, []), i.size]
            begin = 0
            for a, b in zip(places[1:], [*places[2:], None]):
                if b is None or b - begin > self.most:
                    ranges.append((i.path, begin, a))
                    begin = a
        parts: list[list[tuple[str, int, int]]] = []
        room = 0
        for r in sorted(ranges, key=lambda r: (r[1] - r[2], r)):
            if room < r[2] - r[1] or not parts:
                parts.append([])
                room = self.most
            parts[-1].append(r)
            room -= r[2] - r[1]
        return [_Files(tuple(p)) for p in parts] or [_Files(())]

    def read(self, partition):
        tests = [_test(f) for f in self.filters]
        wanted = lambda row: all(t(row) for t in tests)
        system, _ = file_system(self.path)
        rows, held = [], 0
        for name, begin, end in partition.parts:
            with system.open_input_file(name) as f:
                f.seek(begin)
                for row in records(f, name.endswith(".gz"), wanted, self.payload, end - begin):
                    rows.append(row)
                    held += 300 + len(row["payload"] or b"")
                    if held > BATCH_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, schema=_TYPES)
                        rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=_TYPES)


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path, self.level = options["path"], int(options.get("level", "1"))
        self.most, self.overwrite = int(options.get("filebytes", options.get("fileBytes", FILE_BYTES))), overwrite

    def write(self, iterator):
        system, base = file_system(self.path)
        system.create_dir(base, recursive=True)
        files: dict[str, list[int]] = {}
        out, size, cuts = None, 0, []
        try:
            for batch in iterator:
                for row in batch.to_pylist():
                    if out is None or size > self.most:
                        if out is not None:
                            out.close()
                        name, size, cuts = f"part-{uuid.uuid4().hex}.warc.gz", 0, []
                        files[name] = cuts
                        out = system.open_output_stream(posixpath.join(base, name), compression=None, buffer_size=1 << 20)
                    if size - (cuts[-1] if cuts else 0) >= CUT_BYTES:
                        cuts.append(size)
                    raw = member(record(row), self.level)
                    out.write(raw)
                    size += len(raw)
        finally:
            if out is not None:
                out.close()
        return _Written(files)

    def commit(self, messages) -> None:
        system, base = file_system(self.path)
        system.create_dir(base, recursive=True)
        old = [i for i in system.get_file_info(pafs.FileSelector(base)) if i.is_file] if self.overwrite else []
        files = {n: cuts for m in messages if m for n, cuts in m.files.items()}
        with system.open_output_stream(posixpath.join(base, f"_manifest-{uuid.uuid4().hex}"), compression=None) as f:
            f.write(json.dumps(files).encode())
        for i in old:
            if i.base_name not in files:
                system.delete_file(i.path)

    def abort(self, messages) -> None:
        system, base = file_system(self.path)
        for m in messages:
            for n in m.files if m else ():
                system.delete_file(posixpath.join(base, n))


class WarcDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)


def write_archives(df: DataFrame, path: str, level: int = 1) -> None:
    """Write a table with the columns of SCHEMA (missing ones are null) as archives in the folder path."""
    register(df.sparkSession)
    bound_batches(df.sparkSession)
    have = set(df.columns)
    columns = [(F.col(f"`{n}`") if n in have else F.lit(None)).cast(t).alias(n) for n, t in (c.split() for c in SCHEMA.split(", "))]
    df.select(*columns).write.format("warc").mode("append").option("level", level).save(path)


def read_archives(spark: SparkSession, path: str, payload: bool = False) -> DataFrame:
    register(spark)
    return spark.read.format("warc").option("payload", payload).load(path)


#: Payloads of fewer bytes are never revisited.
LEAST_REVISIT = 100


def capture(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Records of pages: of those with equal payloads the smallest id is a response and the others revisit it. A page
    without an id is a response of its own.

    Only ids and digests are shuffled to find the revisits. A filter of fixed size over these, broadcast as a table, parts
    the pages: those that it shuts out are responses and go through no shuffle; the others, which are revisits but for a
    few, are joined with them. AQE splits a digest that many pages share."""
    rows = pages.select(F.col(id_col).alias("k"), F.col(url_col).alias("target_uri"), F.encode(F.coalesce(F.col(html_col), F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("digest", F.sha2("payload", 256))
    long_ = rows.filter((F.col("payload_bytes") >= LEAST_REVISIT) & F.col("k").isNotNull()).select("k", "digest")
    first = long_.groupBy("digest").agg(F.min("k").alias("first"), F.max("k").alias("last")).filter("first < last").drop("last")
    revisits = cut(long_.join(first, "digest").filter("first < k").distinct())
    bit = slot(F.struct("k", "digest")) + 1
    bits = revisits.select(bit.alias("b")).groupBy(F.expr("bitmap_bucket_number(b)").alias("part")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(b))").alias("bits"))
    place = F.expr("bitmap_bit_position(b)")
    byte = F.conv(F.hex(F.substring("bits", (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    rows = rows.withColumn("b", bit).withColumn("part", F.expr("bitmap_bucket_number(b)"))
    rows = rows.join(F.broadcast(bits), "part", "left").withColumn("hit", F.coalesce(F.getbit(byte, (place % 8).cast("int")) == 1, F.lit(False)))
    rows = rows.drop("part", "bits", "b")
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    again = F.col("first").isNotNull()
    joined = rows.filter("hit").join(revisits, ["k", "digest"], "left").unionByName(rows.filter("not hit").withColumn("first", F.lit(None).cast(dict(rows.dtypes)["k"])))
    return joined.select(
        urn(F.col("k")).alias("record_id"),
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        "target_uri",
        F.lit(date).alias("date"),
        F.concat(F.lit("sha256:"), "digest").alias("payload_digest"),
        F.when(again, urn(F.col("first"))).alias("refers_to"),
        "payload_bytes",
        F.when(again, F.lit(None)).otherwise(F.col("payload")).alias("payload"),
    )


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to archives and read back: responses by their payload, revisits by their headers alone."""
    path = shared_path(spark, "warc")
    write_archives(capture(read(spark, sf_dir, "pages")), path)
    number = lambda c: F.regexp_extract(c, r"<urn:page:(-?\d+)>", 1).try_cast("long")
    whole = read_archives(spark, path, payload=True).filter("record_type = 'response'")
    heads = read_archives(spark, path).filter("record_type = 'revisit'")
    return whole.select(
        number("record_id").alias("page_id"), F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_digest"), "record_type", F.lit(None).cast("long").alias("refers_to")
    ).union(heads.select(number("record_id"), "payload_bytes", F.regexp_extract("payload_digest", r"^sha256:([0-9a-f]{64})$", 1), "record_type", number("refers_to")))


#: The same rows from the table alone.
OP8_SQL = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS d FROM pages
), f AS (
  SELECT d, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY d
)
SELECT p.page_id, CAST(p.n AS BIGINT) AS payload_bytes, p.d AS payload_digest,
       CASE WHEN f.first < p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN f.first < p.page_id THEN f.first END AS refers_to
FROM p LEFT JOIN f ON p.d = f.d
"""
