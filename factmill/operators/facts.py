"""Candidate facts with their context, selection of an even set, and units."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factmill import fixed
from factmill.functions import text as T
from factmill.operators import segment
from factmill.operators import terms as X
from factmill.session import cut, number_rows


def with_context(paragraphs: DataFrame, chapter: list[str], order: str = "para", sents: str = "sents") -> DataFrame:
    """One row per good sentence of a paragraph with its definition, example and true_definition. Neighbouring paragraphs
    come from windows within a chapter; all else is within the paragraph's own array.

    Definition: the first usable other sentence that reads like one, else the previous sentence, else the last one of the
    previous paragraph. Example: the next sentence, else the first of the next paragraph; if it equals the definition, the
    first usable sentence that is neither definition nor fact. Rows without three different texts go."""
    w = Window.partitionBy(*chapter).orderBy(order)
    rows = paragraphs.withColumn("_before", F.lag(F.try_element_at(sents, F.lit(-1))).over(w)).withColumn("_after", F.lead(F.get(sents, F.lit(0))).over(w))
    return _context(T.unnest(_judged(rows, sents), sents, "sent", "fact", [*rows.columns, "_usable", "_defines"]).filter(T.is_good_fact("fact")), sents)


def _judged(rows: DataFrame, sents: str) -> DataFrame:
    """Which sentences of a paragraph can be an example, and which read like a definition."""
    rows = rows.withColumn("_usable", F.transform(sents, lambda s: T.at_least_words(s, 5) & ~T.is_junk(s)))
    return rows.withColumn("_defines", F.transform(sents, lambda s: T.is_definition(s)))


def _context(rows: DataFrame, sents: str) -> DataFrame:
    """with_context() from good sentences (sent, fact) with their paragraph's array, _usable, _defines, _before and _after."""
    s, i, fact = F.col(sents), F.col("sent"), F.col("fact")
    pick = lambda test: F.get(F.filter(s, test), F.lit(0))
    usable = lambda j: F.get("_usable", j) & (j != i)
    # Each step binds what the next one uses several times; a filter on plain columns would be pushed down and copy it all.
    step = F.array(
        F.struct(
            pick(lambda x, j: usable(j) & F.get("_defines", j)).alias("true"),
            F.when(i > 0, F.get(s, i - 1)).otherwise(F.col("_before")).alias("before"),
            F.coalesce(F.get(s, i + 1), F.col("_after")).alias("next"),
        )
    )
    step = F.transform(step, lambda r: F.struct(r["true"].isNotNull().alias("true"), F.coalesce(r["true"], r["before"]).alias("definition"), r["next"].alias("next")))
    step = F.transform(
        step,
        lambda r: F.struct(
            r["definition"].alias("definition"),
            F.when(r["next"].eqNullSafe(r["definition"]), pick(lambda x, j: usable(j) & ~x.eqNullSafe(r["definition"]) & (x != fact))).otherwise(r["next"]).alias("example"),
            r["true"].alias("true_definition"),
        ),
    )
    step = F.filter(step, lambda r: (r["definition"] != "") & (r["example"] != "") & (fact != r["definition"]) & (fact != r["example"]) & (r["definition"] != r["example"]))
    return rows.select(*[c for c in rows.columns if c not in ("_before", "_after", "_usable", "_defines", sents)], F.inline_outer(step)).filter("definition is not null")


def score(freq: T.ColumnLike, true_definition: T.ColumnLike) -> Column:
    """Rare terms and true definitions count for more."""
    freq = F.col(freq) if isinstance(freq, str) else freq
    true_definition = F.col(true_definition) if isinstance(true_definition, str) else true_definition
    return F.lit(1.0) / (1 + freq) + F.when(true_definition, 0.5).otherwise(0.0)


def example_terms(rows: DataFrame, freq: DataFrame, keys: list[str], example: str = "example") -> DataFrame:
    """rows with example_key_term, the rarest term of the example by the frequencies of the corpus (null without a term).
    keys tell the rows apart."""
    best = X.choose_key_term(rows.select(*keys, X.term_candidates(example).alias("terms")), freq, keys)
    return rows.join(best.select(*keys, F.col("key_term").alias("example_key_term")), keys, "left")


def named_sentences(sents: T.ColumnLike) -> Column:
    """Place and terms of the sentences of an array that have a term. As one value: from a filter on a column of terms
    Catalyst would find the terms twice."""
    sents = F.col(sents) if isinstance(sents, str) else sents
    return F.filter(F.transform(sents, lambda s, i: F.struct(i.alias("sent"), X.term_candidates(s).alias("terms"))), lambda r: F.size(r["terms"]) > 0)


def _named_and_good(sents: Column) -> Column:
    return F.transform(named_sentences(sents), lambda r: r.withField("good", T.is_good_fact(F.get(sents, r["sent"]))))


def named_paragraphs(paragraphs: DataFrame, chapter: list[str], order: str = "para", sents: str = "sents", others: bool = False) -> DataFrame:
    """Paragraphs with a sentence that has a term: _named (place and terms of these sentences, and which of them are good
    facts), _before and _after (the sentences around the paragraph). Written once: texts are read, split and judged for this
    table alone, and the frequencies and the candidates come from it. Of other paragraphs only the first and the last
    sentence are moved. With others, these are written too, without sentences, and n_sents counts the sentences of each."""
    keys = [*chapter, order]
    rows = paragraphs.withColumn("_named", _named_and_good(F.col(sents)))
    if others:
        rows = rows.withColumn("n_sents", F.size(sents))
    rows = rows.withColumns({"_first": F.get(sents, F.lit(0)), "_last": F.try_element_at(sents, F.lit(-1)), sents: F.when(F.size("_named") > 0, F.col(sents))})
    w = Window.partitionBy(*chapter).orderBy(order)
    rows = rows.withColumn("_before", F.lag("_last").over(w)).withColumn("_after", F.lead("_first").over(w)).drop("_first", "_last")
    return cut((rows if others else rows.filter(F.size("_named") > 0)).select(*keys, *[c for c in rows.columns if c not in keys]))


def named_documents(docs: DataFrame, keys: list[str], fold: bool = True, sents: str = "sents") -> DataFrame:
    """named_paragraphs() of segment.document_paragraphs() with keys, which tell documents apart. A document's paragraphs are
    in its row, so neighbours take no window and no shuffle. Most texts show by one pattern that no sentence has a term; of
    the rest only the paragraphs that may have one, and those beside them, are split, each once."""
    rows = docs.select(*keys, segment.kept_lines("text", fold, terms=True).alias("_kept"))
    mark = lambda r: T.let(T.strip_markers(r["line"]), lambda s: F.struct(r["para"].alias("para"), s.alias("text"), X.may_have_terms(s).alias("maybe")))
    rows = rows.select(*keys, F.transform("_kept", mark).alias("_kept"))
    at = lambda i: F.get("_kept", i)
    beside = lambda i: F.coalesce(at(i)["maybe"], F.lit(False))
    rows = rows.select(*keys, "_kept", F.transform("_kept", lambda r, i: F.when(r["maybe"] | beside(i - 1) | beside(i + 1), segment.split_sentences(r["text"]))).alias("_split"))
    of = lambda i: F.get("_split", i)
    found = F.transform(
        "_split",
        lambda s, i: F.struct(
            at(i)["para"].alias("para"),
            F.when(at(i)["maybe"], _named_and_good(s)).alias("_named"),
            s.alias(sents),
            F.try_element_at(of(i - 1), F.lit(-1)).alias("_before"),
            F.get(of(i + 1), F.lit(0)).alias("_after"),
        ),
    )
    return cut(rows.select(*keys, F.inline_outer(F.filter(found, lambda r: F.size(r["_named"]) > 0))).filter("para is not null"))


def named_frequency(named: DataFrame) -> DataFrame:
    """term_frequency() of all sentences, from named_paragraphs()."""
    return X.term_frequency(T.unnest(named, F.col("_named.terms"), "_m", "terms", []))


def named_candidates(named: DataFrame, freq: DataFrame, chapter: list[str], order: str = "para", sents: str = "sents") -> DataFrame:
    """candidates() from named_paragraphs() and frequencies."""
    keys = [*chapter, order, "sent"]
    keep = [c for c in named.columns if c != "_named"]
    named = named.withColumn("_named", F.filter("_named", lambda r: r["good"])).filter(F.size("_named") > 0)
    rows = T.unnest(_judged(named, sents), "_named", "_m", "_of", [*keep, "_usable", "_defines"])
    rows = rows.withColumns({"sent": F.col("_of.sent"), "terms": F.col("_of.terms")}).withColumn("fact", F.get(sents, F.col("sent"))).drop("_m", "_of")
    chosen = X.choose_key_term(rows, freq, keys)
    rows = _context(rows.drop("terms"), sents).join(chosen, keys)
    return rows.withColumn("score", score("freq", "true_definition"))


def candidates(paragraphs: DataFrame, chapter: list[str], order: str = "para", sents: str = "sents", freq: DataFrame | None = None) -> DataFrame:
    """with_context() with key_term, freq and score, of the sentences that have a term; frequencies count every sentence of
    every paragraph (freq, if the caller has them already). The choice is joined back by the sentence's place."""
    named = named_paragraphs(paragraphs, chapter, order, sents)
    return named_candidates(named, named_frequency(named) if freq is None else freq, chapter, order, sents)


def capped(df: DataFrame, fact: str, term: str, by: list[Column], cap: int = 2) -> DataFrame:
    """Without repeated facts, and at most cap rows per term, in the given order. Spark limits both windows before their
    shuffles (WindowGroupLimit)."""
    once = df.withColumn("_r", F.row_number().over(Window.partitionBy(fact).orderBy(*by))).filter("_r = 1")
    return once.withColumn("_r", F.row_number().over(Window.partitionBy(term).orderBy(*by))).filter(F.col("_r") <= cap).drop("_r")


def even_sample(df: DataFrame, k: int, by: list[str]) -> DataFrame:
    """k rows spread evenly in order (all, if there are no more): places int(i * (n / k)) in double arithmetic. The chosen
    places are few; rows are numbered by a sort over all tasks, not by a window in one."""
    numbered, n = number_rows(df, by, "_n", 0)
    if k >= n:
        return numbered.drop("_n")
    places = df.sparkSession.range(k).select((F.col("id") * (F.lit(float(n)) / k)).cast("long").alias("_n"))
    return numbered.join(F.broadcast(places), "_n").drop("_n")


def select_units(df: DataFrame, target: int = fixed.TARGET_UNITS, order: tuple[str, ...] = ("position",), cap: int = 2) -> DataFrame:
    """The best 2 * target capped candidates, thinned evenly over the book."""
    by = [F.desc("score"), *map(F.col, order)]
    pool = capped(df, "fact", "key_term", by, cap).orderBy(*by).limit(2 * target)
    return even_sample(pool, target, list(order))


def violations(fact="fact", definition="definition", example="example", link="link", key_term="key_term", example_key_term="example_key_term") -> Column:
    """Names of the constraints that a unit breaks; none for a valid one."""
    f, d, e = (F.coalesce(F.col(c), F.lit("")) for c in (fact, definition, example))
    tests = {
        "short_fact": T.word_count(f) < 4,
        "short_definition": T.word_count(d) < 4,
        "short_example": T.word_count(e) < 4,
        "bad_link": ~F.coalesce(F.col(link), F.lit("")).rlike(r"^\d+:\d+$"),
        "term_not_in_fact": F.col(key_term).isNotNull() & ~f.contains(F.col(key_term)),
        "term_not_in_example": F.col(example_key_term).isNotNull() & ~e.contains(F.col(example_key_term)),
        "not_distinct": (f == d) | (f == e) | (d == e),
    }
    return F.filter(F.array(*[F.when(t, F.lit(n)) for n, t in tests.items()]), lambda x: x.isNotNull())


def to_units(selected: DataFrame, order: list[str], start: int = 1) -> tuple[DataFrame, DataFrame]:
    """Valid rows with ids u0001 and so on, and the rest with their violations. Only valid rows take a number; there are no
    more than a few hundred selected rows, so one window is enough."""
    rows = selected.withColumn("violations", violations())
    ok = rows.filter(F.size("violations") == 0).drop("violations")
    number = F.row_number().over(Window.orderBy(*order)) + (start - 1)
    return ok.withColumn("id", T.serial("u", number, 4)), rows.filter(F.size("violations") > 0)


# --- cleaning


def drop_reason() -> Column:
    """Why a unit is junk: an editorial note in any text, or a fact that is a citation or a figure fragment."""
    return (
        F.when(T.is_editorial(F.concat_ws(" ", "fact", "definition", "example")), "editorial_note")
        .when(T.is_citation("fact"), "footnote_citation")
        .when(T.is_figure("fact"), "figure_fragment")
    )


def unit_frequency(units: DataFrame) -> DataFrame:
    """Frequencies over the facts, definitions and examples of all units."""
    texts = T.unnest(units, F.array("fact", "definition", "example"), "_n", "s", [])
    return X.term_frequency(texts.select(X.term_candidates("s").alias("terms")))


def _chosen(units: DataFrame, freq: DataFrame, text: str, name: str) -> DataFrame:
    rows = units.select("id", X.term_candidates(T.strip_markers(text)).alias("terms"))
    best = X.choose_key_term(rows, freq, ["id"]).select("id", F.col("key_term").alias(f"_best_{name}"))
    return rows.withColumnRenamed("terms", f"_terms_{name}").join(best, "id", "left")


def clean_units(units: DataFrame, freq: DataFrame | None = None) -> DataFrame:
    """Units with cleaned texts, new terms where the old ones are not valid, and what was done: action, reason, violations,
    old_key_term, excerpt. Dropped units keep their row, for the report."""
    freq = unit_frequency(units) if freq is None else freq
    rows = units.join(_chosen(units, freq, "fact", "k"), "id").join(_chosen(units, freq, "example", "e"), "id")
    valid = lambda term, terms: F.coalesce(F.array_contains(terms, F.col(term)), F.lit(False))
    rows = rows.withColumn("reason", drop_reason()).withColumn("old_key_term", F.col("key_term"))
    rows = rows.withColumn("_changed", F.lit(False))
    for c in ("fact", "definition", "example"):
        rows = rows.withColumn(f"_new_{c}", T.strip_markers(c))
    rows = rows.withColumn("_changed", (F.col("_new_fact") != F.col("fact")) | (F.col("_new_definition") != F.col("definition")) | (F.col("_new_example") != F.col("example")))
    rows = rows.withColumn("excerpt", F.substring("fact", 1, fixed.EXCERPT))
    rows = rows.withColumn("key_term", F.when(valid("key_term", F.col("_terms_k")), F.col("key_term")).otherwise(F.col("_best_k")))
    rows = rows.withColumn("example_key_term", F.when(valid("example_key_term", F.col("_terms_e")), F.col("example_key_term")).otherwise(F.col("_best_e")))
    for c in ("fact", "definition", "example"):
        rows = rows.withColumn(c, F.col(f"_new_{c}"))
    rows = rows.withColumn("violations", violations())
    rows = rows.withColumn("reason", F.coalesce("reason", F.when(F.size("violations") > 0, "validation")))
    action = (
        F.when(F.col("reason").isNotNull(), "dropped")
        .when(~F.col("key_term").eqNullSafe(F.col("old_key_term")), F.when(F.col("key_term").isNotNull(), "rekeyed").otherwise("training_only"))
        .when(F.col("_changed"), "markers_removed")
        .otherwise("unchanged")
    )
    return rows.withColumn("action", action).drop(*[c for c in rows.columns if c.startswith("_")])


def histogram(report: DataFrame, by: str) -> DataFrame:
    """How often each action, or each reason, occurs; rows without one don't count."""
    return report.filter(F.col(by).isNotNull()).groupBy(F.col(by).alias("name")).agg(F.count("*").alias("n"))


def top_up(units: DataFrame, fresh: DataFrame, minimum: int = fixed.MIN_UNITS, order: tuple[str, ...] = ("position",), freq: DataFrame | None = None) -> DataFrame:
    """Units and, if they are too few, further candidates: none whose fact is there already, none whose term is used twice;
    ids go on after the largest. With freq, the chosen candidates, and not all, get their example terms here."""
    units = cut(units)
    have = units.agg(F.count("*").alias("n"), F.max(F.substring("id", 2, 18).try_cast("long")).alias("top")).first()
    if (needed := minimum - have["n"]) <= 0:
        return units
    used = units.filter("key_term is not null").groupBy("key_term").agg(F.count("*").alias("_used")).filter("_used >= 2")
    left = fresh.join(units.select("fact").distinct(), "fact", "left_anti").join(used, "key_term", "left_anti")
    chosen = select_units(left, needed, order)
    if freq is not None:
        chosen = example_terms(chosen, freq, list(order))
    more, _ = to_units(chosen, list(order), (have["top"] or 0) + 1)
    return units.unionByName(more.select(*units.columns))
