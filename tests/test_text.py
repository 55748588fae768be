import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from factmill import fixed
from factmill.functions import text as T
from factmill.operators import exam, facts, segment, train
from factmill.operators import terms as X


def one(spark, expr, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expr).first()[0]


def test_normalize(spark):
    for s, want in [("The Élan—vital!", "elan vital"), ("a an the", ""), ("Theory of the Doge’s", "theory of doge s"), ("", ""), ("snow_white", "snow_white")]:
        assert one(spark, T.normalize("x"), s) == want
        assert all(not unicodedata.combining(c) for c in one(spark, T.normalize("x"), s))


@pytest.mark.parametrize("s", ["I do not know", "I'm not sure", "I can't recall it", "Not enough information.", "unable to provide", "I do not have access", "not specified in it"])
def test_refusals(spark, s):
    assert one(spark, T.is_refusal("x"), s)


def test_curly_apostrophe_is_no_refusal(spark):
    assert not one(spark, T.is_refusal("x"), "I don’t know")


def test_cloze_blanks_first_occurrence(spark):
    out = spark.createDataFrame([("a.b and a.b", "a.b"), ("none", "x"), ("", "x")], "s string, t string").select(T.cloze("s", "t")).collect()
    assert [r[0] for r in out] == ["____ and a.b", "none", ""]


def test_prompt_passage(spark):
    q = spark.createDataFrame([("B", "1", "x ____ y")], "t string, c string, b string").select(T.question("t", "c", "b").alias("q"))
    assert q.select(T.prompt_passage("q")).first()[0] == "x ____ y"
    assert one(spark, T.prompt_passage("x"), "short") == ""


def test_word_count_and_nulls(spark):
    assert one(spark, T.word_count("x"), "") == 0
    assert one(spark, T.word_count("x"), " a  b\nc ") == 3
    assert one(spark, T.normalize("x"), None) is None


def test_common_prefix(spark):
    df = spark.createDataFrame([([1, 2, 3], [1, 2, 4]), ([5], [6]), ([1, 2], [1, 2])], "a array<int>, b array<int>")
    assert [r[0] for r in df.select(T.common_prefix("a", "b")).collect()] == [2, 1, 1]


def test_sentences(spark):
    s = 'He met Mr. Smith at St. Mark. "Stay!" he said. (Then 3 went.) He said "Yes." He left. it went on. Étoile'
    assert one(spark, segment.split_sentences("x"), s) == ["He met Mr. Smith at St. Mark.", '"Stay!" he said.', "(Then 3 went.", 'He said "Yes.', "He left. it went on. Étoile"]
    assert one(spark, segment.split_sentences("x"), "  ") == []


def test_terms_of_written_cases(spark):
    cases = {
        "The old town of Venice had 40 feet, and 12 men.": ["Venice", "40", "12"],
        "Ahab": [], "Ahab spoke.": [], "Then Ahab spoke.": ["Ahab"],
        "He met Captain Ahab of Nantucket--was WITHOUT him.": ["Captain Ahab of Nantucket"],
        "They saw Romanesque--was late in 1492, in 1066 and 45.": ["Romanesque", "1492", "1066"],
        "It was Cipico WITHOUT a ship.": ["Cipico"],
        "In Plate XIV we see Rome and Rome.": [],
        "There he met Maria de la Cruz.": ["Maria", "Cruz"],
        "Then in March he left O'Neil with 5 ships": ["March", "O'Neil", "5"],
        "": [],
    }
    df = spark.createDataFrame([(k,) for k in cases], "s string").select("s", X.term_candidates("s").alias("t"))
    assert {r["s"]: r["t"] for r in df.collect()} == cases


def naive_pick(rows, k, cap=2):
    used, facts_, out = {}, set(), []
    for fact, term, score, pos in sorted(rows, key=lambda r: (-r[2], r[3])):
        if fact in facts_ or used.get(term, 0) >= cap:
            continue
        facts_.add(fact)
        used[term] = used.get(term, 0) + 1
        out.append((fact, term, score, pos))
        if len(out) >= 2 * k:
            break
    out.sort(key=lambda r: r[3])
    step = len(out) / k
    return out if len(out) <= k else [out[int(i * step)] for i in range(k)]


@pytest.mark.parametrize("seed", range(4))
def test_select_units_equals_greedy_choice(spark, seed):
    rng = random.Random(seed)
    names = [(f"f{i}", f"t{rng.randrange(8)}") for i in range(30)]
    rows = [(*rng.choice(names), rng.choice([0.5, 1.0, 1.5]), p) for p in range(60)]
    k = rng.choice([3, 7, 40])
    got = facts.select_units(spark.createDataFrame(rows, "fact string, key_term string, score double, position int"), k).collect()
    assert sorted(map(tuple, got)) == sorted(naive_pick(rows, k))


@pytest.mark.parametrize("n,k", [(316, 300), (5, 5), (3, 10), (10, 3), (0, 4)])
def test_even_sample_uses_double_steps(spark, n, k):
    got = sorted(r[0] for r in facts.even_sample(spark.range(n), k, ["id"]).collect())
    assert got == (list(range(n)) if k >= n else [int(i * (n / k)) for i in range(k)])


def book(*parts):
    return "\n".join(parts)


LONG = "word " * 300


def chapters(spark, text):
    rows = segment.split_chapters(segment.lines(spark.createDataFrame([("b", text)], "book_id string, text string"))).orderBy("chapter").collect()
    return [(r["chapter"], r["start_off"], r["body"].strip()[:9]) for r in rows], text


def test_chapters(spark):
    got, text = chapters(spark, book("CHAPTER I", "CHAPTER II", "CHAPTER I", "one " + LONG, "CHAPTER II. Title", "two " + LONG))
    assert [g[0] for g in got] == [1, 2] and got[0][2].startswith("one") and got[1][2].startswith("two")
    assert all(text[g[1] :].lstrip().startswith(g[2].split()[0]) for g in got)


def test_front_matter_is_chapter_zero(spark):
    got, _ = chapters(spark, book("front " + LONG * 5, "CHAPTER I", "one " + LONG, "CHAPTER II", "two " + LONG))
    assert [g[0] for g in got] == [0, 1, 2]


def test_roman_headings(spark):
    got, _ = chapters(spark, book("I.", "one " + LONG, "II.", "two " + LONG, "III", "three " + LONG))
    assert [g[0] for g in got] == [1, 2, 3]


@pytest.mark.parametrize("text", ["no headings at all", book("CHAPTER I", "short", "CHAPTER II", "short"), ""])
def test_whole_book_is_one_chapter(spark, text):
    got, _ = chapters(spark, text)
    assert [(g[0], g[1]) for g in got] == [(1, 0)]


def test_paragraphs(spark):
    text = book("a b c d e f", "g h", "", "too short", "", "[Illustration: a b c d e f]", "", "[3] a short citation of six words", "", "plain text of six words,[7] yes")
    ch = spark.createDataFrame([("b", 1, 10, text)], "book_id string, chapter int, start_off long, body string")
    rows = segment.split_paragraphs(ch, ["book_id", "chapter"]).orderBy("para").collect()
    assert [(r["off"] - 10, r["text"]) for r in rows] == [(0, "a b c d e f g h"), (text.index("plain"), "plain text of six words, yes")]


def test_pages(spark):
    df = spark.createDataFrame([("ab\fcd\fe", 0), ("ab\fcd\fe", 4), ("ab\fcd\fe", 6), ("abcd", 3600)], "t string, o long")
    assert [r[0] for r in df.select(segment.page_of("o", form_feeds=segment.form_feeds("t"))).collect()] == [1, 2, 3, 3]


def test_labels_of_all_verdicts(spark):
    rows = [(c, m, r) for c in (0.4, 0.5) for m in (0.4, 0.5) for r in (0.4, 0.5)]
    got = spark.createDataFrame(rows, "c double, m double, r double").select(exam.verdict_label("c", "m", "r")).collect()
    assert [g[0] for g in got] == ["wrong", "refusal", "made_up", "refusal", "correct", "refusal", "correct", "refusal"]
    assert spark.range(1).select(exam.verdict_label(F.lit(1.0), F.lit(0.0), F.lit(0.0), F.lit(True))).first()[0] == "error"


def test_summary_of_nothing(spark):
    empty = spark.createDataFrame([], "is_correct int, is_refusal int, timed_out boolean, error string")
    r = exam.eval_summary(empty, []).first()
    assert (r["answered"], r["correct"], r["accuracy"]) == (0, 0, 0.0)


def test_exact_permutation_is_the_seeded_shuffle(spark):
    want = list(range(20))
    random.Random(42).shuffle(want)
    got = exam.permuted(spark.range(20), 42, ["id"]).orderBy("_p").collect()
    assert [r["id"] for r in got] == want


def test_fill_questions(spark):
    raw = spark.createDataFrame([("Q?", "A", 1), ("R?", "B", 2)], "question string, answer string, ordinal int")
    assert [(r["id"], r["type"], r["aliases"], r["source_passage"]) for r in exam.fill_questions(raw).orderBy("id").collect()] == [("q001", "factual", [], "A"), ("q002", "factual", [], "B")]
    with pytest.raises(ValueError):
        exam.fill_questions(raw.withColumn("answer", F.lit(" ")))
    with pytest.raises(ValueError):
        exam.fill_questions(raw.withColumn("id", F.lit("same")))


def test_bracket_template(spark):
    turns = F.array(*[F.struct(F.lit(r).alias("role"), F.lit(t).alias("text")) for r, t in (("system", "S"), ("user", "U"), ("assistant", "A"), ("user", "V"))])
    assert spark.range(1).select(train.render_chat(turns, "brackets")).first()[0] == "<s>[INST] S\n\nU [/INST] A</s>[INST] V [/INST]"


def test_fixed_lists_have_no_repeats():
    assert len(set(fixed.STOP_TERMS)) == len(fixed.STOP_TERMS)
