"""Questions, deterministic grading, evaluation summaries, blinded pools and final metrics."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factmill import fixed
from factmill.functions import text as T
from factmill.session import cut, number_rows

#: Rows that permuted() takes.
MOST_PERMUTED = 100_000
LABELS = ("correct", "made_up", "refusal", "wrong", "error")


# --- questions


def hash_order(seed: int, *keys: str) -> Column:
    """A key that shuffles rows alike in every engine: md5 of the seed and the row's keys."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]).cast("binary"))


def permuted(df: DataFrame, seed: int, order: list[str], name: str = "_p") -> DataFrame:
    """Each row's place in the seeded Mersenne Twister shuffle of the table in order. The permutation depends on the seed
    and the number of rows alone and is made on the driver, so more than MOST_PERMUTED rows are an error; hash_order()
    shuffles tables of any size."""
    if (n := df.count()) > MOST_PERMUTED:
        raise ValueError(f"{n} rows are too many for this shuffle, of which the limit is {MOST_PERMUTED}")
    places = list(range(n))
    random.Random(seed).shuffle(places)
    moved = df.sparkSession.createDataFrame([(old, new) for new, old in enumerate(places)] or [], "_o long, " + name + " long")
    numbered = df.withColumn("_o", (F.row_number().over(Window.orderBy(*order)) - 1).cast("long"))
    return numbered.join(F.broadcast(moved), "_o").drop("_o")


def excluded_units(practical: DataFrame) -> DataFrame:
    """Distinct units that practical questions rely on."""
    return practical.select(F.explode("source_units").alias("unit_id")).distinct()


def missing_units(practical: DataFrame, units: DataFrame) -> DataFrame:
    """Source units that don't exist; nothing if there are no units at all."""
    if units.isEmpty():
        return excluded_units(practical).limit(0)
    return excluded_units(practical).join(units.select(F.col("id").alias("unit_id")), "unit_id", "left_anti")


def eligible(units: DataFrame, excluded: DataFrame) -> DataFrame:
    return units.filter("key_term is not null and key_term <> ''").join(excluded.select(F.col("unit_id").alias("id")), "id", "left_anti")


def build_questions(units: DataFrame, title: str, excluded: DataFrame, n: int = fixed.QUESTIONS["knowledge"], seed: int = 42, exact: bool = False) -> DataFrame:
    """Fill-in questions on n evenly chosen units, shuffled and then numbered."""
    from factmill.operators.facts import even_sample

    pool = cut(eligible(units, excluded))
    if (have := pool.count()) < n:
        raise ValueError(f"{have} units can be asked about, {n} are needed")
    rows = even_sample(pool, n, ["id"]).select(
        F.lit("factual").alias("type"),
        F.col("id").alias("unit_id"),
        T.question(F.lit(title), T.link_part("link", 1), T.cloze("fact", "key_term")).alias("question"),
        F.col("key_term").alias("answer"),
        F.array().cast("array<string>").alias("aliases"),
        F.col("fact").alias("source_passage"),
        "link",
    )
    if exact:
        return permuted(rows, seed, ["unit_id"]).withColumn("id", T.serial("q", F.col("_p") + 1, 3)).drop("_p")
    number = F.row_number().over(Window.orderBy(hash_order(seed, "unit_id"), "unit_id"))
    return rows.withColumn("id", T.serial("q", number, 3))


def fill_questions(raw: DataFrame) -> DataFrame:
    """Questions of a user with their defaults; empty questions or answers and repeated ids are errors."""
    have = set(raw.columns)
    col = lambda c, kind="string": F.col(c) if c in have else F.lit(None).cast(kind)
    number = F.row_number().over(Window.orderBy("ordinal")) if "ordinal" in have else F.lit(1)
    rows = raw.select(
        F.coalesce(col("id"), T.serial("q", number, 3)).alias("id"),
        F.coalesce(col("type"), F.lit("factual")).alias("type"),
        col("unit_id").alias("unit_id"),
        "question",
        "answer",
        F.coalesce(col("aliases", "array<string>"), F.array().cast("array<string>")).alias("aliases"),
        F.coalesce(col("source_passage"), F.col("answer")).alias("source_passage"),
    )
    problems = question_problems(rows).orderBy(F.desc("empty"), "id").limit(3).collect()
    if bad := [r["id"] for r in problems if r["empty"]]:
        raise ValueError(f"questions without text or answer: {bad}")
    if problems:
        raise ValueError(f"question ids occur twice: {[r['id'] for r in problems]}")
    return rows


def question_problems(questions: DataFrame) -> DataFrame:
    """id, n (its rows) and empty (those without a question or an answer) of ids that occur twice or have empty rows."""
    empty = F.least(*[F.length(F.trim(F.coalesce(c, F.lit("")))) for c in ("question", "answer")]) == 0
    rows = questions.groupBy("id").agg(F.count("*").alias("n"), F.sum(empty.cast("long")).alias("empty"))
    return rows.filter("n > 1 or empty > 0")


def stale_questions(questions: DataFrame, units: DataFrame, excluded: DataFrame) -> DataFrame:
    """Questions whose unit is gone, has another term or is now excluded; those without a unit are never stale."""
    u = units.select(F.col("id").alias("unit_id"), F.col("key_term").alias("_term"), F.lit(True).alias("_there"))
    x = excluded.select("unit_id").distinct().withColumn("_excluded", F.lit(True))
    rows = questions.filter("unit_id is not null").join(u, "unit_id", "left").join(x, "unit_id", "left")
    return rows.filter(F.col("_there").isNull() | ~F.col("_term").eqNullSafe(F.col("answer")) | F.col("_excluded").isNotNull()).drop("_term", "_there", "_excluded")


# --- grading


def is_answer_correct(answer: T.ColumnLike, reference: T.ColumnLike, aliases: T.ColumnLike | None = None) -> Column:
    """Not empty, no refusal, at most 40 words, and the reference or an alias is a run of whole words in it."""
    a, r = (F.coalesce(F.col(x) if isinstance(x, str) else x, F.lit("")) for x in (answer, reference))
    n = T.normalize(a)
    options = F.array(r)
    if aliases is not None:
        options = F.concat(options, F.coalesce(F.col(aliases) if isinstance(aliases, str) else aliases, F.array().cast("array<string>")))
    hit = F.exists(options, lambda x: T.contains_span(n, T.normalize(x)))
    return (a != "") & ~T.is_refusal(a) & (T.word_count(n) <= 40) & F.coalesce(hit, F.lit(False))


def grade_true_false(answer: Column, reference: Column) -> Column:
    a = F.coalesce(answer, F.lit(""))
    said = F.regexp_extract(T.normalize(a), r"\b(true|false)\b", 1)
    expected = F.when(F.lower(F.trim(reference)).startswith("true"), "true").otherwise("false")
    return ((a != "") & ~T.is_refusal(a) & (said == expected)).cast("int")


def chosen_letter(answer: Column, options: Column) -> Column:
    """The letter that an answer names, else that of the one option whose text it holds."""
    a = F.coalesce(answer, F.lit(""))
    n = T.normalize(a)
    texts = F.transform(F.coalesce(options, F.array().cast("array<string>")), lambda o: F.struct(F.substring(o, 1, 1).alias("l"), T.normalize(F.substring(o, 4, 1_000_000)).alias("t")))
    hits = F.filter(texts, lambda o: (o["t"] != "") & n.contains(o["t"]))
    named = lambda p: F.nullif(F.upper(F.regexp_extract(a, p, 1)), F.lit(""))
    return F.coalesce(named(fixed.LETTER_START), named(fixed.LETTER_ANY), F.when(F.size(hits) == 1, F.get(hits, F.lit(0))["l"]))


def grade_multiple_choice(answer: Column, reference: Column, options: Column) -> Column:
    a = F.coalesce(answer, F.lit(""))
    right = F.upper(F.substring(F.trim(reference), 1, 1))
    return ((a != "") & ~T.is_refusal(a) & F.coalesce(chosen_letter(a, options) == right, F.lit(False))).cast("int")


def grade(set_: str = "set", type_: str = "type", answer: str = "model_answer", reference: str = "reference_answer", aliases: str = "aliases", options: str = "options") -> Column:
    """1, 0, or null where only a judge can tell."""
    s, t, a, r = F.col(set_), F.col(type_), F.col(answer), F.col(reference)
    return (
        F.when(s == "knowledge", is_answer_correct(a, r, F.col(aliases)).cast("int"))
        .when((s == "trap") & (t == "true_false"), grade_true_false(a, r))
        .when((s == "trap") & (t == "multiple_choice"), grade_multiple_choice(a, r, F.col(options)))
    )


def eval_records(answers: DataFrame) -> DataFrame:
    """Answers with is_correct (0 after an error, whoever would judge), is_refusal and rounded seconds."""
    failed = F.col("error").isNotNull()
    return answers.select(
        *[c for c in answers.columns if c not in ("seconds", "aliases", "options")],
        F.round("seconds", 1).alias("seconds"),
        F.when(failed, F.lit(0)).otherwise(grade()).alias("is_correct"),
        (T.is_refusal(F.coalesce("model_answer", F.lit(""))) & ~failed).cast("int").alias("is_refusal"),
    )


def eval_summary(records: DataFrame, by: list[str]) -> DataFrame:
    """Counters per group: a null is_correct is in neither part of the accuracy."""
    one = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).cast("long")
    graded = F.col("is_correct").isNotNull()
    right = F.col("is_correct") == 1
    out = records.groupBy(*by).agg(
        F.count("*").alias("answered"),
        one(right).alias("correct"),
        one(graded).alias("graded"),
        one(graded & (F.col("is_correct") == 0) & (F.col("is_refusal") == 0)).alias("wrong_non_refusal"),
        one(~graded).alias("needs_judge"),
        one(F.col("is_refusal") == 1).alias("refusals"),
        one(F.col("timed_out")).alias("timeouts"),
        one(F.col("error").isNotNull()).alias("errors"),
    )
    return out.withColumn("accuracy", T.safe_ratio("correct", "graded", 4))


# --- blinding


def blind(records: DataFrame, seed: int = 1234) -> DataFrame:
    """Pooled answers of both stages in seeded hash order with ids a001 and so on. What a judge may see: id, set, question,
    expected, passage, answer. The rest is the key."""
    numbered, _ = number_rows(records, [hash_order(seed, "source", "set", "question_id"), "source", "set", "question_id"], "_n")
    return numbered.select(
        T.serial("a", "_n", 3).alias("id"),
        "set", "question", F.col("reference_answer").alias("expected"),
        F.when(F.col("set") == "knowledge", F.coalesce(F.nullif("passage", F.lit("")), F.col("reference_answer"))).otherwise(F.col("reference_answer")).alias("passage"),
        F.when(F.coalesce("model_answer", F.lit("")) == "", fixed.NO_ANSWER).otherwise(F.col("model_answer")).alias("answer"),
        "source", "question_id", "type", F.col("is_correct").alias("string_match_correct"),
    )


def visible(blinded: DataFrame) -> DataFrame:
    return blinded.select("id", "set", "question", "expected", "passage", "answer")


def unblinding_key(blinded: DataFrame) -> DataFrame:
    return blinded.select("id", "source", "set", "question_id", "type", "string_match_correct")


CRITERIA = ("correct", "made_up", "refusal")
_PROMPTS = {
    "correct": "Does the answer say the same as the expected answer? Reply Y or N.\nQuestion: %s\nExpected: %s\nAnswer: %s",
    "made_up": "Does the answer state something specific that is not in the expected answer? Reply Y or N.\nQuestion: %s\nExpected: %s\nAnswer: %s",
    "refusal": "Does the answer decline to answer? Reply Y or N.\nQuestion: %s\nExpected: %s\nAnswer: %s",
}


def judge_prompts(items: DataFrame) -> DataFrame:
    """Three prompts for each item, one for each criterion, in one array so that they stay together."""
    expected = F.when(F.col("set") == "knowledge", F.col("passage")).otherwise(F.col("expected"))
    prompts = F.array(*[F.struct(F.lit(c).alias("criterion"), F.format_string(p, "question", expected, "answer").alias("prompt")) for c, p in _PROMPTS.items()])
    return items.select("id", F.explode(prompts).alias("p")).select("id", "p.criterion", "p.prompt")


def verdict_label(correct: T.ColumnLike, made_up: T.ColumnLike, refusal: T.ColumnLike, error: Column | None = None) -> Column:
    """The label of three probabilities: refusal before correct before made_up before wrong; an error is an error."""
    c, m, r = ((F.col(x) if isinstance(x, str) else x) >= 0.5 for x in (correct, made_up, refusal))
    label = F.when(r, "refusal").when(c, "correct").when(m, "made_up").otherwise("wrong")
    return label if error is None else F.when(error, "error").otherwise(label)


def breakdown(judgments: DataFrame, key: DataFrame, sets: list[str], sources: tuple[str, ...] = ("baseline", "trained")) -> DataFrame:
    """Counters for every set and source, also those without judgments."""
    rows = judgments.select("id", "label").join(key, "id")
    one = lambda c: F.sum(F.when(c, 1).otherwise(0))
    match = F.col("string_match_correct")
    practical = F.col("type") == "practical"
    got = rows.groupBy("set", "source").agg(
        F.count("*").alias("total"),
        *[one(F.col("label") == x).alias(x) for x in LABELS],
        one(match.isNotNull()).alias("string_matched"),
        one(match.isNotNull() & ((F.col("label") == "correct") == (match == 1))).alias("agree_with_string_match"),
        one(practical & (F.col("label") == "refusal")).alias("practical_type_refusals"),
        one(practical).alias("practical_type_total"),
    )
    grid = judgments.sparkSession.createDataFrame([(a, b) for a in sets for b in sources], "set string, source string")
    counters = [c for c in got.columns if c not in ("set", "source")]
    return grid.join(got, ["set", "source"], "left").select("set", "source", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counters])


def agreement(counts: DataFrame) -> DataFrame:
    """Share of string-matched answers on which judge and string match agree, where there are any."""
    return counts.filter("string_matched > 0").select("set", "source", F.round(F.col("agree_with_string_match") / F.col("string_matched"), 3).alias("agreement"))


def final_metrics(counts: DataFrame) -> DataFrame:
    """One row of before and after metrics and their status. With no practical set, refusals are those of practical
    questions in the knowledge set, out of the usual number if there are none; sets_present tells which sets there are."""
    at = lambda s, src, c: F.sum(F.when((F.col("set") == s) & (F.col("source") == src), F.col(c)))
    has = lambda s: F.max((F.col("set") == s).cast("int")) == 1
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    rows = counts.agg(
        zero(at("knowledge", "baseline", "correct")).alias("before_correct"),
        zero(at("knowledge", "trained", "correct")).alias("after_correct"),
        zero(at("knowledge", "trained", "total")).alias("after_total"),
        zero(at("knowledge", "trained", "made_up")).alias("made_up_answers"),
        zero(F.when(has("practical"), at("practical", "trained", "refusal")).otherwise(at("knowledge", "trained", "practical_type_refusals"))).alias("refusals"),
        zero(F.when(has("practical"), at("practical", "trained", "total")).otherwise(F.coalesce(F.nullif(at("knowledge", "trained", "practical_type_total"), F.lit(0)), F.lit(fixed.QUESTIONS["practical"])))).alias("practical_total"),
        at("practical", "baseline", "correct").alias("practical_correct_before"),
        at("practical", "trained", "correct").alias("practical_correct_after"),
        (at("trap", "baseline", "made_up") + at("trap", "baseline", "wrong")).alias("trap_hallucinations_before"),
        (at("trap", "trained", "made_up") + at("trap", "trained", "wrong")).alias("trap_hallucinations_after"),
        at("trap", "trained", "refusal").alias("trap_refusals_after"),
        at("trap", "trained", "correct").alias("trap_correct_after"),
        F.array_join(F.array_sort(F.collect_set("set")), ",").alias("sets_present"),
    )
    rows = rows.withColumn("improvement", F.col("after_correct") - F.col("before_correct"))
    rows = rows.withColumn("hallucinations_total", F.col("made_up_answers") + zero(F.col("trap_hallucinations_after")))
    met = (F.col("before_correct") <= fixed.BASELINE_MAX_CORRECT) & (F.col("after_correct") >= fixed.TARGET_AFTER_CORRECT) & (F.col("hallucinations_total") <= fixed.MAX_MADE_UP)
    rows = rows.withColumn("status", F.when(met, "ready_for_submission").otherwise("criteria_not_met"))
    return rows.withColumn("refusals_of", F.concat_ws("/", "refusals", "practical_total"))


def gate(summary: DataFrame, stage: str) -> str:
    """PASS or FAIL of a knowledge run: few right answers before training, many after."""
    n = summary.agg(F.coalesce(F.sum("correct"), F.lit(0))).first()[0]
    ok = n <= fixed.BASELINE_MAX_CORRECT if stage == "baseline" else n >= fixed.TARGET_AFTER_CORRECT
    return "PASS" if ok else "FAIL"


def same_questions(left: DataFrame, right: DataFrame, key: str = "id", ordinal: str | None = None) -> bool:
    """Whether two runs asked the same questions: as bags, or in the same order with ordinal."""
    columns = [key] if ordinal is None else [key, ordinal]
    return question_differences(left, right, columns).isEmpty()


def question_differences(left: DataFrame, right: DataFrame, columns: list[str]) -> DataFrame:
    """What one of two runs asked and the other did not, as often as it did not, with its side (left or right)."""
    a, b = left.select(*columns), right.select(*columns)
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def replay_questions(results: DataFrame, questions: DataFrame) -> DataFrame:
    """The questions of a finished run in full; those not in the table come from the results. A changed text is an error."""
    q = questions.select("id", F.col("question").alias("_q"), "answer", "aliases", "source_passage")
    rows = results.select("id", "type", "question", "reference_answer").join(q, "id", "left")
    if changed := rows.filter("_q is not null and _q <> question").limit(3).collect():
        raise ValueError(f"the text of questions changed: {[r['id'] for r in changed]}")
    return rows.select("id", "type", "question", F.coalesce("answer", "reference_answer").alias("answer"), F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases"), F.coalesce("source_passage", "reference_answer").alias("source_passage"))
