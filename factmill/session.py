"""A session with the settings that the engine is tested with."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def session(name: str = "factmill", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true", "spark.sql.execution.arrow.pyspark.enabled": "true", "spark.ui.enabled": "false",
    }
    return builder.config(map=settings | conf).getOrCreate()


def spread(df: DataFrame) -> DataFrame:
    """A small table that lies in fewer partitions than there are cores, dealt to all of them; any other as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def cut(df: DataFrame) -> DataFrame:
    """df written to the shared checkpoint folder (spark.checkpoint.dir) and read from there. Where that is unset, a
    temporary folder serves in local mode; a cluster has to name one that all machines share."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        given = spark.conf.get("spark.checkpoint.dir", None)
        if not given and spark.sparkContext.master.startswith("local-cluster") or not given and not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(given or tempfile.mkdtemp(prefix="factmill-"))
    return df.checkpoint(eager=True)


def number_rows(df: DataFrame, order: list, name: str, start: int = 1, each: tuple[str, str] | None = None) -> tuple[DataFrame, int]:
    """df with a dense number in order, and how many rows there are. Rows are sorted over all tasks and checkpointed; a task's
    rows are numbered within it, and the numbers of rows of the tasks before it, one row for each task, are added. each, a
    column of counts and a name: so many rows for each row, with their place in it from 0, made after the sort."""
    rows = df.orderBy(*order)
    if each:
        rows = rows.select("*", F.posexplode(F.array_repeat(F.lit(True), F.col(each[0]))).alias(each[1], "_there")).drop("_there", each[0])
    rows = rows.withColumn("_task", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    rows = cut(rows)
    counts = sorted((r["_task"], r["n"]) for r in rows.groupBy("_task").agg(F.count("*").alias("n")).collect())
    before, offsets = start, []
    for task, n in counts:
        offsets.append((task, before))
        before += n
    first = df.sparkSession.createDataFrame(offsets, "_task int, _first long")
    numbered = rows.join(F.broadcast(first), "_task")
    return numbered.withColumn(name, F.col("_first") + F.col("_at")).drop("_task", "_at", "_first"), before - start


def running_sums(df: DataFrame, keys: list[str], piece: str, order: list[str], sums: dict[str, Column]) -> DataFrame:
    """df with, for each name of sums, the sum of its column over the earlier rows of the same keys, in order, and over all
    of them (name_all). Column piece rises with the order and cuts the rows of long keys: a task sums one piece, and what
    comes before it is added from a table with one row for each piece. Null keys are keys like others."""
    own = {f"_{kind}{i}": c for i, k in enumerate(keys) for kind, c in (("null", F.col(k).isNull()), ("key", F.coalesce(F.col(k).cast("string"), F.lit(""))))}
    by = [*own, piece]
    rows = df.withColumns(own).withColumns({f"_of_{n}": c.cast("long") for n, c in sums.items()})
    pieces = rows.groupBy(*by).agg(*[F.coalesce(F.sum(f"_of_{n}"), F.lit(0)).alias(f"_of_{n}") for n in sums])
    book = Window.partitionBy(*own)
    earlier = book.orderBy(piece).rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.select(*by, *[F.coalesce(F.sum(f"_of_{n}").over(earlier), F.lit(0)).alias(f"_to_{n}") for n in sums], *[F.sum(f"_of_{n}").over(book).alias(f"{n}_all") for n in sums])
    within = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({n: F.coalesce(F.sum(f"_of_{n}").over(within), F.lit(0)) for n in sums}).join(pieces, by)
    rows = rows.withColumns({n: F.col(n) + F.col(f"_to_{n}") for n in sums})
    return rows.select(*df.columns, *sums, *[f"{n}_all" for n in sums])
