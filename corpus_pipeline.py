"""A corpus pipeline: five stages over documents, each written as Parquet and read again as the next one's input.

Language identification drops what it rejects; near duplicates keep one document of each group; contaminated documents
go; secrets are replaced in the texts; what is left is encoded. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factmill.llm import decontaminate, language, near, pieces, secret_scan
from factmill.llm.common import crc_mod, read, remove, shared_path

#: Before the names of columns that an operator adds, so that they can't clash with those of documents.
OWN = "_op_"


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the model knows; the model is learned from the rows that are not held out."""
    model = language.fit(docs.filter(crc_mod("doc_id", 5) != 0))
    found = language.identify(docs, model, keep=tuple(docs.columns), prefix=OWN)
    return found.filter(~F.col(OWN + "rejected")).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component, that of the smallest id: five-word shingles, similarity 0.8."""
    return near.deduplicated(docs, size=5, percent=80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents none of whose words are in a benchmark window, however long they are: a passage of a test that stays in a
    long document is learned as well as one in a short document."""
    found = decontaminate.find(docs, read(spark, sf_dir, "benchmark"), keep=tuple(docs.columns), prefix=OWN)
    return found.filter(F.size(OWN + "starts") == 0).select(*docs.columns)


def replace_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, its secrets replaced by their kind; n_chars is that of the new text."""
    rest = tuple(c for c in docs.columns if c != "doc_id")
    found = secret_scan.scan(docs, redacted=True, keep=rest, prefix=OWN)
    new = {"text": F.col(OWN + "redacted")}
    if "n_chars" in docs.columns:
        changed = F.size(OWN + "spans") > 0
        new["n_chars"] = F.when(changed, F.length(OWN + "redacted").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return found.select(*[new.get(c, F.col(c)).alias(c) for c in docs.columns])


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document, their digest, and whether they decode to the same text."""
    out = pieces.round_trip(docs, keep=("lang", "source", "text"), lists=True, prefix=OWN)
    packed, decoded = OWN + "packed", OWN + "decoded"
    return out.select(
        "doc_id",
        "lang",
        "source",
        (F.octet_length(packed) / 4).cast("long").alias("n_tokens"),
        F.sha2(packed, 256).alias("ids_sha256"),
        (F.col(decoded) == F.coalesce("text", F.lit(""))).alias("same_text"),
        F.col(OWN + "ids").alias("ids"),
    )


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", replace_secrets),
    ("pieces", encode),
]

#: SQL cannot express the stages; tests/llm compares them with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. What a stage returns is written to the shared folder and read again; it is deleted when
    the next stage's is written, so only the last but one is left, of which the result is made."""
    docs, before = read(spark, sf_dir, "documents"), None
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            path = shared_path(spark, f"pipeline-{name}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
            if before:
                remove(before)
            before = path
    return docs
