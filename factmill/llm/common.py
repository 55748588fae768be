"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in an Arrow batch that goes to Python; whole texts may be long, so this is far below Spark's default.
BATCH_ROWS = 1000
BATCH_BYTES = 16 << 20


def bound_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small enough for long texts; a smaller value that the session has already set stays."""
    for key, most in (
        ("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS),
        ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES),
    ):
        try:
            now = int(re.sub(r"\D", "", str(spark.conf.get(key, "0"))) or 0)
            if now <= 0 or now > most:
                spark.conf.set(key, str(most))
        except Exception as e:  # a version of Spark without this setting
            if "CONFIG" not in str(e).upper():
                raise


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a temporary one is made in
    local mode (tests); a cluster has to name one, as its executors would not see a folder of the driver's machine."""
    given = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not given:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        given = tempfile.mkdtemp(prefix="factmill-")
        spark.conf.set("spark.checkpoint.dir", given)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(given)
    return given.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark)}/factmill-{name}-{uuid.uuid4().hex}"


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if m := re.match(r"file:/*(/.*)", path):
        return pafs.LocalFileSystem(), m[1]
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


def remove(path: str) -> None:
    """Delete a folder of the shared folder and all that is in it."""
    system, base = file_system(path)
    if system.get_file_info(base).type == pafs.FileType.Directory:
        system.delete_dir(base)


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and go on from there, so that lost executors cost no recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def map_batches(
    df: DataFrame,
    schema: str,
    prepare: Callable[[], Callable[[pa.RecordBatch], Iterable[pa.RecordBatch] | pa.RecordBatch | None]],
) -> DataFrame:
    """mapInArrow with state per task: prepare() runs once in each task and returns the function for its batches."""
    bound_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = prepare()
        for batch in batches:
            out = step(batch)
            if out is None:
                continue
            if isinstance(out, pa.RecordBatch):
                yield out
            else:
                yield from out

    return df.mapInArrow(run, schema)


def texts_of(batch: pa.RecordBatch, column: str) -> list[str]:
    """The texts of a batch, null as the empty string."""
    return [x or "" for x in batch.column(column).to_pylist()]


#: Bits of the filter of ids(); a fixed 4 MB, whatever the input.
FILTER_BITS = 1 << 25


def slot(column: str | F.Column) -> F.Column:
    """The bit of an id in the filter of ids()."""
    return F.pmod(F.xxhash64(column), F.lit(FILTER_BITS))


def id_filter(ids: DataFrame, column: str) -> bytes:
    """A filter of fixed size with the bit of every id set, for tests that may let others pass."""
    bit = slot(column) + 1  # Spark numbers bits, and the parts of a bitmap, from 1
    parts = (
        ids.select(bit.alias("s"))
        .groupBy(F.expr("bitmap_bucket_number(s)").alias("part"))
        .agg(F.expr("bitmap_construct_agg(bitmap_bit_position(s))").alias("bits"))
    )
    whole = bytearray(FILTER_BITS >> 3)
    for r in parts.toLocalIterator():  # at most FILTER_BITS / 32768 rows of 4 KB
        at = (r["part"] - 1) * 4096
        whole[at : at + len(r["bits"])] = r["bits"]
    return bytes(whole)


def append_columns(
    df: DataFrame,
    keep: Iterable[str],
    text_col: str,
    added: str,
    prepare: Callable[[], Callable[[list[str | None]], list[pa.Array]]],
    prefix: str = "",
) -> DataFrame:
    """The columns in keep and those that a function of a batch's texts makes (added: their schema), their names after
    prefix. Columns travel under internal names, so clashing names do no harm, and the text travels once, kept or not."""
    kinds = dict(df.dtypes)
    own = {f"c{i}": c for i, c in enumerate(dict.fromkeys(keep))}
    text = next((k for k, c in own.items() if c == text_col), "t")
    schema = ", ".join([*(f"{k} {kinds[c]}" for k, c in own.items()), added])
    new = [x.split()[0] for x in re.sub(r"<.*?>+", "", added).split(", ")]

    def begin():
        work = prepare()

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            made = work(batch.column(text).to_pylist())
            return pa.RecordBatch.from_arrays([*(batch.column(k) for k in own), *made], [*own, *new])

        return step

    rows = keyed(df, **own, **({} if text in own else {"t": text_col}))
    out = map_batches(rows, schema, begin)
    return out.select(*[F.col(k).alias(c) for k, c in own.items()], *[F.col(c).alias(prefix + c) for c in new])


def keyed(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named input columns, under internal names; extra and clashing columns of df do no harm."""
    return df.select(*[df[c].alias(k) for k, c in columns.items()])


def hash_sample(
    rows: DataFrame,
    group: str,
    key: str,
    per_group: int,
    total: int,
    chars: int,
    sized: Callable[[DataFrame], DataFrame] | None = None,
) -> list[tuple]:
    """group and key of at most per_group distinct keys of every group, those of smallest hash.

    There are at most about total keys in all (but one of each group), and their texts have at most chars characters in all
    (but a first one of each group); both are dealt to the groups alike. rows has the characters of a key's text as n, or
    sized() adds them to found keys (group, key, h) and drops those that cannot be used. A bound on the hash, from the
    number of a group's distinct keys, lets about four times as many keys through as are wanted, however often a key is
    repeated; where too few are usable it is raised until enough come or the group is taken whole. What comes to the
    driver is a row for each group and those few keys.
    """
    spark, top = rows.sparkSession, (1 << 63) - 1
    kind = rows.schema[group].dataType.simpleString()
    counts = {r[0]: r[1] for r in rows.groupBy(group).agg(F.approx_count_distinct(key)).collect()}
    per = max(1, min(per_group, total // max(1, len(counts))))
    budget = chars // max(1, len(counts))
    share = {g: 4.0 * per / max(1, n) for g, n in counts.items()}
    taken: list[tuple] = []
    while share:
        bounds = spark.createDataFrame([(g, min(top, int(min(1.0, x) * 2.0**62) * 2)) for g, x in share.items()], f"{group} {kind}, _most long")
        found = rows.withColumn("h", F.xxhash64(key).bitwiseAND(F.lit(top))).join(F.broadcast(bounds), group).filter("h <= _most or _most >= 9223372036854775806")
        if sized is None:
            found = found.groupBy(group, key, "h").agg(F.max("n").alias("n"))
        else:
            found = sized(found.select(group, key, "h").distinct())
        own: dict = {g: [] for g in share}
        for r in found.select(group, key, "h", "n").collect():
            own[r[0]].append((r[2], str(r[1]), r[1], r[3]))
        for g, keys in own.items():
            if len(keys) < per and share[g] < 1:
                share[g] *= 8
                continue
            del share[g]
            spent = 0
            for at, (_, _, k, n) in enumerate(sorted(keys, key=lambda x: x[:2])[:per]):
                spent += n
                if at and spent > budget:
                    break
                taken.append((g, k))
    return taken


def crc_mod(doc_id: str | F.Column, n: int):
    """crc32 of the id as text, modulo n."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % n if isinstance(doc_id, str) else F.crc32(doc_id.cast("string").cast("binary")) % n
