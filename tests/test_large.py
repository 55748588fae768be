"""What keeps large tables from one row, one task or repeated work: pieces of books, of keys and of paragraphs."""

import time

import pytest
from pyspark.sql import functions as F

from factmill import fixed
from factmill.functions import text as T
from factmill.operators import facts, segment
from factmill.operators import terms as X
from factmill.plans import queries
from factmill.session import running_sums


def test_running_sums_cross_pieces_and_null_keys(spark):
    df = spark.createDataFrame([(k, i, i % 5) for k in ("a", "", None) for i in range(40)], "k string, i int, v int").repartition(5)
    got = running_sums(df.withColumn("piece", F.floor(F.col("i") / 7)), ["k"], "piece", ["i"], {"s": F.col("v")}).collect()
    want = {(k, i): sum(j % 5 for j in range(i)) for k in ("a", "", None) for i in range(40)}
    assert len(got) == 120 and {(r["k"], r["i"]): r["s"] for r in got} == want and {r["s_all"] for r in got} == {80}


def test_lines_of_a_book_that_is_never_one_row(spark, tmp_path):
    texts = [(1, "one\ntwo", "en"), (2, None, "en"), (3, "", "en"), (4, "x\n", "de"), (11, "three", "en"), (12, "no language", None)]
    spark.createDataFrame(texts, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    want = []
    for lang in ("en", "de", None):
        rows = [t for _, t, x in texts if x == lang]
        book, off = "".join(f"CHAPTER {n}\n\n{t}\n\n" for n, t in enumerate(rows, 1) if t is not None), 0
        for i, line in enumerate(book.split("\n")):
            want.append((lang or "", i, line, off))
            off += len(line) + 1
    got = [(r["book_id"] or "", r["line_no"], r["line"], r["off"]) for r in queries.synthetic_lines(spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(want)


@pytest.mark.parametrize("size", [1, 3, 4096])
def test_chapters_do_not_depend_on_pieces(spark, monkeypatch, size):
    monkeypatch.setattr(segment, "PIECE", size)
    long = "word " * 300
    titled = "\n".join(["front " + long * 5, "CHAPTER I", "one " + long, "CHAPTER II", "short", "CHAPTER III", "", "three " + long])
    books = [("a", titled), ("b", "CHAPTER I\nshort\nCHAPTER II\nshort"), ("c", "plain\ntext"), ("d", "\n".join(f"{n}.\n{n} {long}" for n in ("I", "II", "III")))]
    rows = segment.split_chapters(segment.lines(spark.createDataFrame(books, "book_id string, text string"))).collect()
    got = sorted((r["book_id"], r["chapter"], r["start_off"], r["body"].split()[0]) for r in rows)
    at = lambda b, s: dict(books)[b].index(s) + len(s)
    romans = [("d", i, 0 if i == 1 else None, n) for i, n in enumerate(("I", "II", "III"), 1)]
    assert [g for g in got if g[0] == "a"] == [("a", 0, 0, "front"), ("a", 1, at("a", "CHAPTER I"), "one"), ("a", 2, at("a", "CHAPTER III"), "three")]
    assert [g for g in got if g[0] in "bc"] == [("b", 1, 0, "CHAPTER"), ("c", 1, 0, "plain")] and [(g[0], g[1], g[3]) for g in got if g[0] == "d"] == [(b, i, n) for b, i, _, n in romans]
    assert next(r["body"] for r in rows if r["book_id"] == "b") == dict(books)["b"]


# --- sentences and terms


def test_sentences_split_as_before(spark):
    """The dots of abbreviations are found from the dot, and ends are trimmed before the split and not after it."""
    plain = lambda c: F.filter(
        F.transform(F.split(F.regexp_replace(c, r"\b(" + "|".join(fixed.ABBREVIATIONS) + r")\.", "$1" + fixed.EOF_MARK), fixed.SENTENCE_BREAK), lambda s: F.regexp_replace(F.replace(s, F.lit(fixed.EOF_MARK), F.lit(".")), r"(?U)^\s+|\s+$", "")),
        lambda s: s != "",
    )
    texts = ["", " ", "  A b. C d. ", "Mr.Mrs. X. Dr. Y", "aMr. Z. Mt.Mt. A", "No. 5. St.. B", "a. B. C", "x. \n Y! \"Z\" ? 1", ". A", "etc. Etc. VS. vs. A"]
    rows = spark.createDataFrame([(x,) for x in texts], "x string").select("x", segment.split_sentences("x").alias("got"), plain(F.col("x")).alias("want")).collect()
    assert [r for r in rows if r["got"] != r["want"]] == []


def test_text_shortcuts_do_not_change_results(spark):
    texts = ["", " a", "a ", "a b c d e f", "a b  c d e ", " a b c d e f ", "café", "é́", "́", "x PROJECT Gutenberg", "Page 3 : x", "page x", "corrected to", "KTRANSCRIBER", "[4] x [12", "İHTML version", None]
    c = F.col("x")
    cases = {
        "words": (T.at_least_words(c, 6), T.word_count(c) >= 6),
        "one": (T.at_least_words(c, 1), T.word_count(c) >= 1),
        "strip": (T.strip_space(c), F.regexp_replace(c, r"(?U)^\s+|\s+$", "")),
        "markers": (T.strip_markers(c), F.regexp_replace(F.regexp_replace(c, fixed.FOOTNOTE_MARKER, ""), r"(?U)^\s+|\s+$", "")),
        "editorial": (T.is_editorial(c), c.rlike(fixed.EDITORIAL)),
        "fold": (T.fold_accents(c), F.regexp_replace(F.translate(c, T._ACCENTED, T._PLAIN), r"\p{M}+", "")),
    }
    rows = spark.createDataFrame([(x,) for x in texts], "x string").select("x", *[e.alias(f"{n}{i}") for n, pair in cases.items() for i, e in enumerate(pair)]).collect()
    assert [(r["x"], n) for r in rows for n in cases if r[f"{n}0"] != r[f"{n}1"]] == []


def test_terms_of_a_sentence_that_repeats_a_name_take_linear_time(spark):
    """So many words took minutes, as each one looked for the first word again, and the stack of the pattern."""
    texts = [("La " * 60_000 + "Thor",), ("the " + "Thor Ahab " * 20_000 + "in 1492",)]
    began = time.perf_counter()
    got = [r[0] for r in spark.createDataFrame(texts, "x string").select(X.term_candidates("x")).collect()]
    assert [len(x) for x in got] == [1, 2] and got[0][0].endswith("La Thor") and got[1][1] == "1492" and time.perf_counter() - began < 30


def test_sentences_without_a_possible_term(spark, monkeypatch):
    """MAYBE_TERM lets every sentence pass that has one."""
    texts = ["Ahab spoke.", "Ahab--was late.", "Ahab' said", "ahab saw Rome", "A walk of 5 feet", "5 feet", "ÉParis x", "É Paris", "Ab\nCd", "\nCd x", "x-Ya", "The Cd", "", None]
    df = spark.createDataFrame([(x,) for x in texts], "x string")
    some = X.term_candidates("x")
    assert fixed.MAYBE_TERM
    monkeypatch.setattr(fixed, "MAYBE_TERM", "")
    rows = df.select("x", some.alias("some"), X.term_candidates("x").alias("all")).collect()
    assert [r for r in rows if r["some"] != r["all"]] == [] and sum(len(r["all"] or []) for r in rows) == 6


def test_sentences_are_numbered_from_counts_of_paragraphs(spark):
    rows = spark.createDataFrame([(d, p, ["s"] * ((d + p) % 4)) for d in range(30) for p in range(5)], "doc_id int, para int, sents array<string>")
    want = [(d, p, s) for d in range(30) for p in range(5) for s in range((d + p) % 4)]
    got = segment.number_sentences(rows.repartition(7), ["doc_id", "para"]).select("doc_id", "para", "sent", "position").orderBy("position").collect()
    assert [tuple(r) for r in got] == [(*w, i) for i, w in enumerate(want, 1)]


#: Most passes over the texts of documents; book_meta also counts paragraphs and characters.
PASSES = {"capped_top_facts": 1, "units": 1, "train_views": 1, "top_up": 1, "book_meta": 4, "fact_context": 1, "fact_score": 1, "key_term_choice": 1, "cloze_questions": 1, "leakage_antijoin": 1, "missing_sources": 1, "drop_reason_hist": 1}


@pytest.mark.parametrize("name", sorted(PASSES))
def test_texts_are_split_once(spark, small, monkeypatch, name):
    calls, split = [], segment.split_sentences
    monkeypatch.setattr(segment, "split_sentences", lambda c: calls.append(1) or split(c))
    plan = queries.QUERIES[name](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert len(calls) + plan.count("documents.parquet") <= PASSES[name]


def test_good_facts_are_judged_with_the_terms(spark, small, monkeypatch):
    """Candidates are made from good sentences only, and not from all with a judgment in each of their two branches."""
    monkeypatch.setattr(facts, "cut", lambda df: df.localCheckpoint())
    named = queries._named(spark, small)
    of = named.selectExpr("inline(_named)", "sents").select("good", "terms", T.is_good_fact(F.get("sents", F.col("sent"))).alias("want")).collect()
    assert {r["good"] for r in of} == {True, False} and [r for r in of if r["good"] != r["want"] or not r["terms"]] == []
    monkeypatch.setattr(T, "is_good_fact", lambda c: pytest.fail("judged again"))
    assert facts.named_candidates(named, facts.named_frequency(named), ["doc_id"]).count() > 0


def test_what_may_have_a_term_is_as_before(spark):
    parts = ["A", "b", "Z", "5", " ", "-", "’", "'", "\n", "é", "É", "\U0001d400", "\u0301", "_", "."]
    texts = [(a + b + c + e,) for a in ["", *parts] for b in parts for c in parts for e in ["", *parts]]
    old = r"(?s)\d|^[A-Z][a-zA-Z]*['’\-]|.\b[A-Z][a-zA-Z'’\-]"
    df = spark.createDataFrame(texts, "x string")
    assert df.filter(F.col("x").rlike(fixed.MAYBE_TERM) != F.col("x").rlike(old)).limit(5).collect() == []


def test_stripped_texts_are_bound_once(spark):
    """Each place that used the stripped text had a copy of the expression, and so had the places around it."""
    df = spark.createDataFrame([(" a[1] ",), (None,), ("",), ("b [2]",)], "x string")
    out = df.select(segment.split_sentences(T.strip_markers("x")).alias("s"))
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Contains(") <= 1 and [r["s"] for r in out.collect()] == [["a"], None, [], ["b"]]


def test_terms_are_found_once_for_the_choice(spark, small, monkeypatch):
    """A filter on the column of terms was pushed down with a copy of all that finds them."""
    plans = []
    monkeypatch.setattr(queries, "cut", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or df)
    queries.QUERIES["key_term_choice"](spark, small)
    assert plans[0].count("ducats") == 1


def test_book_meta_splits_texts_once(spark, small, monkeypatch):
    """A scan is left for the number of characters."""
    calls, split = [], segment.split_sentences
    monkeypatch.setattr(segment, "split_sentences", lambda c: calls.append(1) or split(c))
    plan = queries.QUERIES["book_meta"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert (len(calls), plan.count("documents.parquet")) == (1, 1)


@pytest.mark.parametrize("name", ["book_meta", "top_up"])
def test_candidates_that_are_used_twice_are_written(spark, small, monkeypatch, name):
    plans, select = [], facts.select_units
    monkeypatch.setattr(facts, "select_units", lambda df, *a, **k: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or select(df, *a, **k))
    queries.QUERIES[name](spark, small)
    assert plans and not [p for p in plans if "known as" in p]


def test_what_may_have_terms_has_all_sentences_that_may(spark):
    """Lines are stripped of markers and split; where one of their sentences may have a term, the text may too."""
    parts = ["A", "bc", "Z", "5", " ", "-", "’", ")", '"', "\n", "é", "\u0301", "\u00a0", ".", "! ", ". Ab", "Mr.", "etc.", "[12]", "\r"]
    texts = [(a + b + c + e,) for a in ["", "x. ", *parts] for b in parts for c in parts for e in ["", *parts]]
    df = spark.createDataFrame(texts, "x string").repartition(8)
    lines = F.transform(F.split("x", "\n"), lambda y: segment.split_sentences(T.strip_markers(y)))
    some = F.exists(lines, lambda y: F.exists(y, lambda s: s.rlike(fixed.MAYBE_TERM)))
    rows = df.select("x", some.alias("some"), X.may_have_terms("x").alias("may"), T.let(T.strip_markers("x"), X.may_have_terms).alias("line"))
    assert rows.filter("some and not may or some and not line and not contains(x, '\n')").limit(5).collect() == []
    got = {r["may"] for r in spark.createDataFrame([("He went.\nShe came. \"So it is.",), ("He went. Mr. Ab came.",)], "x string").select(X.may_have_terms("x").alias("may")).collect()}
    assert rows.filter("some").count() > 1000 and got == {True} and not spark.createDataFrame([("He went.\nShe came.)  So it is! A b.",)], "x string").select(X.may_have_terms("x")).first()[0]


def test_a_long_word_of_capitals_takes_linear_time(spark):
    texts = [("A" * 300_000,), ("\nAb" * 100_000,), (". Ab" * 100_000,)]
    began = time.perf_counter()
    spark.createDataFrame(texts, "x string").select(X.may_have_terms("x")).collect()
    assert time.perf_counter() - began < 30


def _odd_documents(spark):
    plain = "it has six small words here. So it goes on and on."
    name = "They met old Bartholomew Longfellow near the river Arno in 1492. It was a town that has many small houses. All went home."
    texts = [None, "", plain, name, f"{plain}\n{name}\n{plain}", f"{name}\n\nshort\n{plain}\nToo short\n{name} Été à Pisa.", f"{plain}\n{plain}\n{name}\n{name}", " \n" + name + "  ", f"{plain}\nMr. Ahab is of the old town there. {plain}", "[4] See Smith.\n" + name + "[12]\n" + plain]
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")


def test_named_documents_are_named_paragraphs(spark, small, monkeypatch):
    monkeypatch.setattr(facts, "cut", lambda df: df.localCheckpoint())
    for docs in (_odd_documents(spark), queries.docs(spark, small).select("doc_id", "text")):
        want = facts.named_paragraphs(segment.document_paragraphs(docs.withColumn("lang", F.lit("en"))).drop("line", "lang"), ["doc_id"])
        got = facts.named_documents(docs, ["doc_id"]).select(*want.columns)
        rows = [sorted(map(repr, df.collect())) for df in (got, want)]
        assert rows[0] == rows[1] and len(rows[0]) > 4


@pytest.mark.parametrize("name", ["fact_score", "cloze_questions", "leakage_antijoin", "missing_sources"])
def test_paragraphs_far_from_terms_are_not_split(spark, tmp_path, monkeypatch, name):
    """Every paragraph was split and searched, and all of them were shuffled for their neighbours."""
    split, plans, cut = segment.split_sentences, [], facts.cut
    far = "it is unsplit and has no name in it. So it goes on."
    rows = [(r["doc_id"], r["text"] if r["text"] is None else f"{far}\nit stands between and has no name here.\n{r['text']}\nit stands between and has no name here.\n{far}", "en") for r in _odd_documents(spark).collect()]
    spark.createDataFrame([*rows, (99, far, "en")], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, 1), (1, 0)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    monkeypatch.setattr(segment, "split_sentences", lambda c: F.when(c.contains("unsplit"), F.split(F.raise_error(F.lit("split")).cast("string"), "x")).otherwise(split(c)))
    monkeypatch.setattr(facts, "cut", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or cut(df))
    queries.QUERIES[name](spark, str(tmp_path)).collect()
    assert "_named" in plans[0] and "Window" not in plans[0] and plans[0].count("ducats") == plans[0].count("known as") + 1 == 1
