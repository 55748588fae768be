"""The three processes: build units, evaluate a stage, evaluate blindly."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factmill import backends, fixed
from factmill.operators import exam, facts, segment
from factmill.session import cut
from factmill.sources import files


def book_paragraphs(books: DataFrame, chars_per_page: int = fixed.CHARS_PER_PAGE) -> DataFrame:
    """book_id, chapter, para, off, page and sents of a table of books (book_id, text)."""
    chapters = segment.split_chapters(segment.lines(books))
    paras = segment.split_paragraphs(chapters, ["book_id", "chapter"])
    feeds = books.select("book_id", segment.form_feeds("text").alias("_ff"))
    rows = paras.join(feeds, "book_id").withColumn("page", segment.page_of("off", chars_per_page, F.col("_ff"))).drop("_ff")
    return rows.withColumn("sents", segment.split_sentences("text")).filter(F.size("sents") > 0)


def _candidates(paras: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Candidate facts with their link, and the frequencies of terms, which are counted once and written."""
    named = facts.named_paragraphs(paras, ["book_id", "chapter"])
    freq = cut(facts.named_frequency(named))
    return facts.named_candidates(named, freq, ["book_id", "chapter"]).withColumn("link", F.concat_ws(":", "chapter", "page")), freq


PLACE = ["book_id", "chapter", "para", "sent"]


def build_units(
    books: DataFrame, target: int = fixed.TARGET_UNITS, chars_per_page: int = fixed.CHARS_PER_PAGE, least_units: int = fixed.MIN_UNITS, least_chars: int = fixed.MIN_BOOK_CHARS
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Units of all books together, rejected rows, and a row of meta data for each book. Full-corpus steps are the term
    frequencies and the selection of the best. A target out of bounds, a book of fewer than least_chars characters and
    fewer than least_units valid units are errors."""
    if not fixed.MIN_UNITS <= target <= fixed.MAX_UNITS:
        raise ValueError(f"target must be from {fixed.MIN_UNITS} to {fixed.MAX_UNITS}")
    whole = books.withColumn("title", files.detect_title("text", "book_id")).withColumn("text", files.strip_boilerplate("text"))
    if short := [r["book_id"] for r in whole.filter(F.length("text") < least_chars).select("book_id").limit(5).collect()]:
        raise ValueError(f"books of fewer than {least_chars} characters: {short}")
    paras = book_paragraphs(whole.select("book_id", "text"), chars_per_page)
    rows, freq = _candidates(paras)
    chosen = facts.example_terms(facts.select_units(rows, target, tuple(PLACE)), freq, PLACE)
    units, rejected = facts.to_units(cut(chosen), PLACE)
    units = cut(units)
    if (n := units.count()) < least_units:
        raise ValueError(f"{n} valid units, {least_units} are needed")
    count = lambda df, name: df.groupBy("book_id").agg(F.count("*").alias(name))
    meta = paras.groupBy("book_id").agg(F.countDistinct("chapter").alias("chapters"), F.sum(F.size("sents")).alias("sentences"))
    source = F.col("source_file") if "source_file" in books.columns else F.col("book_id")
    meta = whole.select(
        "book_id", "title", source.alias("source_file"), F.length("text").alias("characters"), files.page_method(segment.form_feeds("text"), chars_per_page).alias("page_numbering")
    ).join(meta, "book_id", "left").join(count(rows, "candidates"), "book_id", "left").join(count(units, "units"), "book_id", "left")
    return units, rejected, meta.fillna(0, ["chapters", "sentences", "candidates", "units"])


def clean_units(units: DataFrame, books: DataFrame, meta: DataFrame, minimum: int = fixed.MIN_UNITS) -> tuple[DataFrame, DataFrame]:
    """Cleaned units, topped up to minimum from the books with links and example terms of their own, and the report of what
    was done. Pages are as large as they were when the units were built (page_numbering of the books' meta data)."""
    report = cut(facts.clean_units(units))
    kept = report.filter("action <> 'dropped'").select("id", "link", "fact", "definition", "example", "key_term", "example_key_term")
    size = meta.agg(F.max(files.page_size("page_numbering"))).first()[0] or fixed.CHARS_PER_PAGE
    rows, freq = _candidates(book_paragraphs(books.select("book_id", files.strip_boilerplate("text").alias("text")), size))
    return facts.top_up(kept, rows, minimum, tuple(PLACE), freq), report


def run_extra_sets(spark: SparkSession, sets: dict[str, DataFrame], table: str, stage: str, backend, other: dict[str, DataFrame] | None = None) -> dict[str, DataFrame]:
    """The records of a stage for each named set of questions, in the order of their names. A set that the other stage has
    answered must have the same questions in the same order (id, ordinal) there, else nothing is run."""
    for name, questions in sets.items():
        if other and name in other and not exam.same_questions(questions, other[name], "id", "ordinal"):
            raise ValueError(f"the other stage was asked other questions, or in another order: {name}")
    return {name: evaluate_stage(spark, questions, table, f"{stage}/{name}", backend)[0] for name, questions in sorted(sets.items())}


def evaluate_stage(spark: SparkSession, questions: DataFrame, table: str, stage: str, backend) -> tuple[DataFrame, DataFrame, str]:
    """Records and summary of a stage, and whether it passes its gate; a repeated run answers only what is pending."""
    from factmill.streaming.incremental import evaluate

    answers = evaluate(spark, questions, table, stage, backend)
    more = questions.select("id", "aliases", "options")
    records = exam.eval_records(answers.join(more, "id", "left"))
    summary = exam.eval_summary(records, ["set"])
    return records, summary, exam.gate(summary.filter("set = 'knowledge'"), stage)


def evaluate_blind(spark: SparkSession, records: DataFrame, backend, evaluator: str, evaluated_family: str, seed: int = 1234) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Judgments, counts and final metrics of pooled, blinded answers of both stages."""
    backends.check_family(evaluator, evaluated_family)
    sets = sorted(r[0] for r in files.available_sets(records).collect())
    if "knowledge" not in sets:
        raise ValueError("both stages of the knowledge set are needed")
    blinded = exam.blind(records.filter(F.col("set").isin(sets)), seed)
    scores = backends.score(exam.judge_prompts(exam.visible(blinded)), backend)
    wide = scores.groupBy("id").pivot("criterion", list(exam.CRITERIA)).agg(F.first("p_yes"))
    rounded = [F.round(c, 4).alias(c) for c in exam.CRITERIA]
    judgments = wide.select("id", *rounded).withColumn("label", exam.verdict_label(*exam.CRITERIA))
    counts = exam.breakdown(judgments, exam.unblinding_key(blinded), sets)
    return judgments, counts, exam.final_metrics(counts)
