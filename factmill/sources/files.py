"""Books, question sets and results as files: readers with fallbacks, checks, and atomic small sinks."""

from __future__ import annotations

import json
import os
import re
import tempfile
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factmill import fixed
from factmill.functions import text as T
from factmill.operators.exam import excluded_units, missing_units

SETS = ("knowledge", "practical", "trap")
STAGES = ("baseline", "trained")
TRAP_SCHEMA = "id int, question string, type string, correct_answer string, options array<string>, category string, trap_kind string, expected_behavior string"
PRACTICAL_SCHEMA = "id int, question string, type string, expected_understanding string, source_units array<string>, topic string"


def decode_text(raw: bytes) -> str:
    """UTF-8 with or without a mark, else Windows-1252, else Latin-1; line ends become \\n, form feeds stay."""
    for code in ("utf-8-sig", "cp1252", "latin-1"):
        try:
            return re.sub("\r\n?", "\n", raw.decode(code))
        except UnicodeDecodeError:
            continue
    raise AssertionError("latin-1 decodes everything")


def read_books(spark: SparkSession, path: str) -> DataFrame:
    """book_id (the file's stem) and text of every file; blank files are an error. Executors decode."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            yield pd.DataFrame({"path": frame["path"], "text": [decode_text(bytes(b)) for b in frame["content"]]})

    rows = spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, text string")
    rows = rows.select(F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1).alias("book_id"), "text")
    return rows.withColumn("text", F.when(T.strip_space("text") == "", F.raise_error(F.concat(F.lit("blank book: "), F.col("book_id")))).otherwise(F.col("text")))


def detect_title(text: T.ColumnLike, stem: T.ColumnLike) -> F.Column:
    """The title line near the start, else the file's name in title case."""
    text, stem = (F.col(x) if isinstance(x, str) else x for x in (text, stem))
    found = F.trim(F.regexp_extract(F.substring(text, 1, 5000), fixed.TITLE_LINE, 1))
    return F.coalesce(F.nullif(found, F.lit("")), F.initcap(F.regexp_replace(stem, "[_-]+", " ")))


def page_size(method: T.ColumnLike) -> F.Column:
    """The characters a page that a method of numbering names, as in estimated_1800_chars_per_page; null for form feeds."""
    method = F.col(method) if isinstance(method, str) else method
    return F.regexp_extract(method, r"^estimated_(\d+)_", 1).try_cast("int")


def page_method(form_feeds: F.Column, chars_per_page: int) -> F.Column:
    return F.when(F.size(form_feeds) > 0, "form_feed").otherwise(f"estimated_{chars_per_page}_chars_per_page")


def strip_boilerplate(text: T.ColumnLike) -> F.Column:
    """What stands between the archive's marks, where they are."""
    text = F.col(text) if isinstance(text, str) else text
    rest = F.element_at(F.split(text, fixed.ARCHIVE_START, 2), -1)
    return T.strip_space(F.get(F.split(rest, fixed.ARCHIVE_END, 2), F.lit(0)))


def load_json(path: str, default=None, required: bool = False):
    """A small JSON file: strictly, then without comments and trailing commas; else the default, or an error if required."""
    p = Path(path)
    if not p.exists() or not (raw := p.read_text("utf-8")).strip():
        if required:
            raise FileNotFoundError(f"missing or empty: {path}")
        return default
    try:
        return json.loads(raw)
    except ValueError:
        pass
    # Strings are matched first, so that what looks like a comment or comma inside one stays.
    plain = re.sub(r'("(?:\\.|[^"\\])*")|//[^\n]*|/\*.*?\*/', lambda m: m[1] or "", raw, flags=re.S)
    plain = re.sub(r'("(?:\\.|[^"\\])*")|,(?=\s*[}\]])', lambda m: m[1] or "", plain)
    try:
        return json.loads(plain)
    except ValueError as e:
        if required:
            raise ValueError(f"not JSON: {path}: {e}") from e
        return default


def save_json(path: str, value) -> None:
    """Write a small JSON file at once: to a temporary file beside it, then renamed."""
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    fd, temporary = tempfile.mkstemp(dir=os.path.dirname(path) or ".", suffix=".part")
    try:
        with os.fdopen(fd, "w", encoding="utf-8") as f:
            json.dump(value, f, ensure_ascii=False, indent=2)
        os.chmod(temporary, 0o644)
        os.replace(temporary, path)
    except BaseException:
        os.unlink(temporary)
        raise


def update_results(path: str, section: dict) -> dict:
    """Merge keys into a results file; what is not an object counts as empty."""
    old = load_json(path, {})
    new = (old if isinstance(old, dict) else {}) | section
    save_json(path, new)
    return new


def backup_once(path: str, backup: str):
    """The first state of a file: from its backup, which is made if there is none, so a second run starts where the first did."""
    if not os.path.exists(backup):
        save_json(backup, load_json(path, required=True))
    return load_json(backup, required=True)


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def _frame(spark: SparkSession, source, schema: str) -> DataFrame:
    return source if isinstance(source, DataFrame) else spark.read.schema(schema).option("multiLine", True).json(source)


def trap_problems() -> F.Column:
    """What is wrong with a raw trap question."""
    empty = lambda c: F.coalesce(F.trim(F.col(c)), F.lit("")) == ""
    tests = {
        "no_id": F.col("id").isNull(),
        "no_question": empty("question"),
        "no_answer": empty("correct_answer"),
        "bad_type": ~F.coalesce(F.col("type"), F.lit("")).isin("true_false", "multiple_choice", "open_ended"),
        "no_options": (F.col("type") == "multiple_choice") & (F.coalesce(F.size("options"), F.lit(0)) < 1),
    }
    return F.filter(F.array(*[F.when(t, F.lit(n)) for n, t in tests.items()]), lambda x: x.isNotNull())


def trap_questions(spark: SparkSession, source) -> DataFrame:
    """Trap questions in common form; options follow the question on lines of their own. A bad question is an error."""
    rows = _frame(spark, source, TRAP_SCHEMA).withColumn("_p", trap_problems())
    rows = rows.withColumn("question", F.when(F.size("_p") > 0, F.raise_error(F.concat(F.lit("bad trap question: "), F.array_join("_p", ",")))).otherwise(F.col("question")))
    with_options = F.concat_ws("\n", "question", F.array_join(F.coalesce("options", F.array().cast("array<string>")), "\n"))
    return rows.select(
        T.serial("t", "id", 2).alias("id"), F.lit("trap").alias("set"), "type",
        F.when(F.col("type") == "multiple_choice", with_options).otherwise(F.col("question")).alias("question"),
        F.col("correct_answer").alias("answer"), "options", "trap_kind", F.array().cast("array<string>").alias("aliases"),
    )


def practical_questions(spark: SparkSession, source, units: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Practical questions in common form, and the units they name that don't exist (unit_id; none without units)."""
    raw = _frame(spark, source, PRACTICAL_SCHEMA)
    missing = excluded_units(raw).limit(0) if units is None else missing_units(raw, units)
    rows = raw.select(
        T.serial("p", "id", 2).alias("id"), F.lit("practical").alias("set"), F.lit("practical").alias("type"), "question",
        F.col("expected_understanding").alias("answer"), "source_units", F.array().cast("array<string>").alias("aliases"),
    )
    return rows, missing


def load_set(spark: SparkSession, name: str, knowledge: DataFrame | None = None, traps=None, practical=None, units: DataFrame | None = None) -> DataFrame:
    """The questions of a set by its name."""
    if name == "knowledge":
        if knowledge is None:
            raise ValueError("knowledge questions are made from units and passed in")
        return knowledge
    if name == "trap":
        return trap_questions(spark, traps)
    if name == "practical":
        return practical_questions(spark, practical, units)[0]
    raise ValueError(f"no such set: {name}")


def parse_sets(names: str) -> list[str]:
    out = [n.strip() for n in names.split(",") if n.strip()]
    if bad := [n for n in out if n not in SETS] or not out:
        raise ValueError(f"no such set: {bad}; sets are {', '.join(SETS)}")
    return out


def run_path(base: str, stage: str, name: str) -> str:
    """Where a run's rows are: one table, partitioned by stage and set."""
    return f"{base}/stage={stage}/set={name}"


def load_complete(records: DataFrame, expected: int, required: bool = True) -> DataFrame | None:
    """A run's rows if all questions are answered; none if it is missing and not required."""
    n = records.count()
    if n == 0 and not required:
        return None
    if n < expected:
        raise ValueError(f"{n} of {expected} questions are answered")
    return records


def available_sets(records: DataFrame) -> DataFrame:
    """Sets that both stages have; knowledge must be among them."""
    rows = records.groupBy("set").agg(F.countDistinct("source").alias("stages"))
    return rows.filter("stages = 2").select("set")


def report(summary: DataFrame) -> str:
    """A summary per set, for the console."""
    lines = [f"{r['set']:<12} {r['correct']:>5}/{r['graded']:<5} right, {r['refusals']} refused, {r['needs_judge']} to judge" for r in summary.orderBy("set").collect()]
    return "\n".join(lines)
