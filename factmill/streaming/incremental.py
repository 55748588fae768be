"""Work that can be taken up again: pending rows, append-only results, and logs as streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def pending(questions: DataFrame, done: DataFrame, label: str) -> DataFrame:
    """Questions that no finished row of this run answers: a row counts if its run label and the question's text are the
    same and it has no error."""
    ok = done.filter((F.col("label") == label) & F.col("error").isNull()).select("id", "question").distinct()
    return questions.join(ok, ["id", "question"], "left_anti")


def pending_items(items: DataFrame, judged: DataFrame, fingerprint: Column) -> DataFrame:
    """Items not judged under the same evaluator, seed, sets and total; rows with errors count as judged here."""
    return items.join(judged.filter(F.col("fingerprint") == fingerprint).select("id").distinct(), "id", "left_anti")


def run_fingerprint(evaluator: str, seed: int, sets: list[str], total: int) -> Column:
    return F.md5(F.lit(f"{evaluator}|{seed}|{','.join(sets)}|{total}").cast("binary"))


def latest(df: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """The last row of each key."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(seq)))).filter("_r = 1").drop("_r")


def merge_results(parts: DataFrame) -> DataFrame:
    """Key and value of the last writer of each key."""
    return latest(parts, ["key"], "seq").select("key", "value")


def loss_history(log: DataFrame, keys: list[str]) -> DataFrame:
    """Steps, the last step's loss, the best loss and the last status of each run."""
    return log.groupBy(*keys).agg(F.count("*").alias("steps"), F.max_by("loss", "step").alias("final_loss"), F.min("loss").alias("best_loss"), F.max_by("status", "step").alias("status"))


def resume_stream(questions: DataFrame, table: str, label: str, answer: Callable[[DataFrame], DataFrame], checkpoint: str) -> StreamingQuery:
    """Answer a stream of questions batch by batch, appending only what is pending, so that a repeated batch adds nothing."""

    def batch(df: DataFrame, _: int) -> None:
        spark = df.sparkSession
        todo = df.dropDuplicates(["id", "question"])
        if spark.catalog.tableExists(table):
            todo = pending(todo, spark.table(table), label)
        answer(todo).withColumn("label", F.lit(label)).write.mode("append").saveAsTable(table)

    return questions.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def loss_stream(log: DataFrame, delay: str = "10 minutes", every: str = "1 day") -> DataFrame:
    """Windowed counts and mean of a stream of log rows with event time ts (a timestamp without zone is read as UTC)."""
    rows = log.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    return rows.groupBy(F.window("ts", every).alias("w"), "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean_value")).select(F.col("w.start").alias("start"), "event_type", "n", "mean_value")


def evaluate(spark: SparkSession, questions: DataFrame, table: str, label: str, backend, batch_rows: int = 32) -> DataFrame:
    """Answer what is pending with a backend and append it; the whole run's rows come back. Errors stop the run at its end."""
    from factmill.backends import generate

    todo = pending(questions, spark.table(table), label) if spark.catalog.tableExists(table) else questions
    generate(todo, backend, batch_rows).withColumn("label", F.lit(label)).write.mode("append").saveAsTable(table)
    rows = spark.table(table).filter(F.col("label") == label)
    rows = rows.withColumn("_ok", F.col("error").isNull().cast("int")).withColumn("_r", F.row_number().over(Window.partitionBy("id", "question").orderBy(F.desc("_ok")))).filter("_r = 1")
    if failed := rows.filter("error is not null").limit(3).collect():
        raise RuntimeError(f"answers failed: {[(r['id'], r['error']) for r in failed]}")
    return rows.drop("_ok", "_r")
