"""Every operator and stage on nulls, empty and very long texts, repeated rows, empty tables and clashing columns."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from factmill.llm import decontaminate, language, near, pieces, pii, secret_scan, topk, toxicity, url_filter, warc

LONG = "word " * 40_000
TEXTS = [(1, None), (2, ""), (3, " \n\t "), (4, LONG), (5, "Same text of several words here."), (5, "Same text of several words here."), (6, "Same text of several words here."), (None, "No id."), (7, "x" * 60_000), (8, "@" * 3000 + "+1" * 3000), (9, "1" * 30_000)]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, t string, k int, c0 string, spans string, score double, n_words long, packed string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en", None, None if t is None else len(t), "t", 1, "c", "s", 0.0, 1, "p") for i, t in TEXTS], SCHEMA)


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 0), (2, 1), (4, 1), (5, 0), (6, None), (9, 0), (9, 1), (None, 1)], "doc_id long, toxic int")


def test_pieces(docs, none):
    rows = pieces.round_trip(docs).select("doc_id", F.hex("packed").alias("p"), "decoded").collect()
    assert len(rows) == len(TEXTS)
    by = {r["doc_id"]: r for r in rows}
    assert by[1]["p"] == by[2]["p"] == "0100000002000000" and by[1]["decoded"] == ""
    assert by[4]["decoded"] == LONG and by[7]["decoded"] == "x" * 60_000
    assert pieces.round_trip(none).count() == 0 and pieces.encode(none).count() == 0


def test_pii(docs, none):
    rows = {r["doc_id"]: r["spans"] for r in pii.detect(docs).collect()}
    assert rows[1] == rows[2] == rows[3] == [] and len(rows[8]) == 0 and pii.detect(none).count() == 0


def test_secrets(docs, none):
    rows = {r["doc_id"]: r for r in secret_scan.scan(docs, redacted=True).collect()}
    assert rows[1]["redacted"] is None and rows[2]["redacted"] == "" and rows[9]["redacted"] == "[hex]"
    assert secret_scan.scan(none).count() == 0


def test_decontamination(spark, docs, none):
    bench = spark.createDataFrame([(1, None), (2, ""), (3, "SAME text, of several!"), (3, "same text of several"), (4, "word " * 13)], "item_id long, text string")
    rows = {r["doc_id"]: r for r in decontaminate.find(docs, bench).collect()}
    assert rows[5]["items"] == [3] and (rows[5]["starts"], rows[5]["ends"]) == ([0], [4])
    assert rows[4]["n_words"] == 40_000 and rows[4]["ends"] == [40_000] and rows[1]["n_words"] == 0
    assert all(r["items"] == [] for r in decontaminate.find(docs, bench.limit(0)).collect())
    assert decontaminate.find(none, bench).count() == 0


def test_language(docs, none):
    model = language.fit(docs, per_language=3)
    rows = {r["doc_id"]: r for r in language.identify(docs, model).collect()}
    assert rows[1]["lang_pred"] == rows[2]["lang_pred"] == rows[3]["lang_pred"] == rows[9]["lang_pred"] == "und" and rows[5]["lang_pred"] == "en"
    empty = language.fit(none)
    assert {r["lang_pred"] for r in language.identify(docs, empty).collect()} == {"und"}
    assert language.identify(none, model).count() == 0


def test_toxicity(docs, none, labels):
    index = toxicity.fit(docs, labels)
    rows = toxicity.score(docs, index).collect()
    assert len(rows) == len(TEXTS) and all(0 <= r["score"] <= 1 for r in rows)
    unfitted = toxicity.fit(none, labels)
    assert {r["score"] for r in toxicity.score(docs, unfitted).collect()} == {unfitted.share}
    assert toxicity.score(docs, toxicity.fit(docs, labels.limit(0))).first()["score"] == 0.0
    assert toxicity.score(none, index).count() == 0


def test_near_duplicates(docs, none):
    rows = near.near_duplicates(docs).collect()
    assert len(rows) == len(TEXTS)
    by = {r["doc_id"]: r for r in rows}
    assert by[5]["component_id"] == by[6]["component_id"] == 5 and by[1]["component_id"] == 1 and by[3]["n_shingles"] == 0 and by[7]["n_shingles"] == 1
    assert near.near_duplicates(none).count() == 0
    kept = near.deduplicated(docs)
    assert kept.columns == docs.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(["1", "2", "3", "4", "5", "None", "7", "8", "9"])


def test_deduplicated_rows_keep_their_columns_and_a_defined_one_stays(spark):
    text = "one two three four five six seven eight"
    rows = [(1, text, "b", "keep", 5), (1, text, "a", "keep", 6), (2, text, "c", "x", 7), (None, text, "d", "y", 8), (3, None, None, "z", 9), (3, None, "e", "z", 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, _id string, _hash int").withColumn("kept", F.lit("k")).withColumn("m", F.create_map(F.lit("a"), F.lit(1)))
    for parts in (1, 4):
        got = near.deduplicated(df.repartition(parts))
        assert got.columns == df.columns
        kept = sorted((str(r["doc_id"]), str(r["lang"]), r["_id"], r["_hash"], r["kept"]) for r in got.collect())
        assert len(kept) == 3 and kept[0][0] == "1" and kept[0][2] == "keep" and kept[-1][:2] == ("None", "d") and kept[1][0] == "3"
        first = kept if parts == 1 else first
        assert kept == first


def test_topk(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.5]), (20, [1.0, 0.5]), (20, [0.25, 0.25]), (1, None), (2, [1.0, None]), (3, [nan, 1.0]), (4, [inf, 0.0]), (5, [1.0]), (None, [1.0, 1.0]), (6, [-1.0, -0.001]), (40, []), (7, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted(map(tuple, topk.search(df).select("query_id", "rank", "vec_id", "score").collect()))
    q0 = [r for r in got if r[0] == 0]
    assert [(r[2], r[3]) for r in q0] == [(20, 64 * 64 + 32 * 32), (20, 64 * 16 + 32 * 16), (6, -64 * 64 - 32)]
    assert len([r for r in got if r[0] == 20]) == 6 and [r for r in got if r[0] == 40] == [(40, 1, 7, 0)]
    assert topk.search(df.limit(0)).count() == 0
    big = spark.createDataFrame([(0, [3e30, 1.0]), (1, [3e30, 1.0]), (2, [1.0, 1.0])], "vec_id long, embedding array<float>")
    assert [r["score"] for r in topk.search(big).orderBy("rank").collect()][0] == (1 << 63) - 1


def test_topk_with_clashing_columns_and_the_largest_doubles(spark):
    rows = [(0, [1.0, 2.0]), (1, [1e308, 1.0]), (2, [3.0, -1e308]), (3, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit("clash") for c in ("i", "v", "uid", "g", "h", "side", "ids", "score")})
    assert [tuple(r) for r in topk.search(df).collect()] == [(0, 1, 3, 64 * 64 + 128 * 64)]


def test_samples_of_repeated_rows(spark):
    """One id with most of the rows takes no other language's, label's or id's place."""
    many = spark.range(200_000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("le chat et le chien").alias("text"), F.lit("fr").alias("lang"))
    few = spark.range(100, 140).select(F.col("id").alias("doc_id"), F.concat(F.lit("the cat "), F.regexp_replace(F.sha2(F.col("id").cast("string"), 256), "(.{6})", "$1 ")).alias("text"), F.lit("en").alias("lang"))
    docs = many.unionByName(few)
    assert language.fit(docs).langs == ["en", "fr"]
    labels = docs.select("doc_id", (F.col("lang") == "fr").cast("int").alias("toxic"))
    index = toxicity.fit(docs, labels)
    assert 7 in index.ids and len(index.ids) > 5 and index.y.sum() == 1 and len(set(index.ids.tolist())) == len(index.ids)


def test_more_languages_than_a_hundred(spark):
    rows = [(10 * i + j, f"{chr(97 + i // 12) * 3}{chr(97 + i % 12) * 3} " * 5, f"l{i:03}") for i in range(120) for j in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(docs, texts=200)
    assert len(model.langs) == 120
    assert sum(r["lang_pred"] == r["lang"] for r in language.identify(docs, model, keep=("lang",)).collect()) > 350


def test_equal_cosines_go_to_the_smaller_id_and_first_language():
    texts = ["bad thing"] * 40 + ["good thing"] * 40
    index = toxicity.Index(list(range(80)), texts, [1] * 40 + [0] * 40, 0.5)
    place, _ = index.nearest(*index.vectors(["bad thing"])[0])
    assert index.ids[place].tolist() == list(range(toxicity.NEAREST))
    model = language.Model(["same words here"] * 6, ["en", "fr"] * 3)
    assert model.predict(["same words here"])[0][0] == "en"


def test_urls(spark):
    rows = [(1, None), (2, "no scheme"), (3, "http://"), (4, "http://A.COM/x"), (4, "http://A.COM/x"), (5, "://com"), (6, "http://" + "a." * 5000 + "net/fr/"), (7, "http://x.test?q")]
    df = spark.createDataFrame(rows, "page_id long, url string").withColumn("host", F.lit("clash"))
    got = {r["page_id"]: tuple(r)[1:] for r in url_filter.filter_urls(df).collect()}
    assert got[1] == got[2] == ("", "", None, "allow") and got[4] == ("a.com", "/x", "com/", "allow") and got[5] == ("com", "", None, "allow")
    assert got[6][2:] == ("net/fr/", "block") and got[7] == ("x.test", "", None, "block")
    assert url_filter.filter_urls(df.limit(0)).count() == 0


def test_warc(spark, tmp_path):
    rows = [(1, "http://a/\r\nInjected: x", None), (2, None, ""), (3, "u", "é" * 100), (4, "u", "é" * 100), (4, "u", "é" * 100), (5, "u", "a\r\n\r\nb" * 50), (None, "u", "é" * 100), (6, "u", "z" * 99), (7, "u", "z" * 99)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash"))
    path = f"file://{tmp_path}/w"
    warc.write_archives(warc.capture(pages), path)
    back = warc.read_archives(spark, path, payload=True).collect()
    assert len(back) == len(rows)
    by = {r["record_id"]: r for r in back}
    assert by["<urn:page:3>"]["payload"].decode() == "é" * 100 and by["<urn:page:4>"]["refers_to"] == "<urn:page:3>" and by["<urn:page:5>"]["payload"] == b"a\r\n\r\nb" * 50
    assert by["<urn:page:7>"]["record_type"] == "response" and by["<urn:page:>"]["record_type"] == "response" and by["<urn:page:1>"]["payload"] == b""
    empty = f"file://{tmp_path}/e"
    warc.write_archives(warc.capture(pages.limit(0)), empty)
    assert warc.read_archives(spark, empty).count() == 0


def test_every_stage(spark, docs, none, small):
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, small)
        n = out.count()
        assert n <= len(TEXTS) and (name == "pieces" or out.columns == docs.columns), name
        assert stage(spark, none, small).count() == 0, name
