import json

import pytest
from pyspark.sql import functions as F

from factmill import backends
from factmill.operators import exam
from factmill.plans import pipelines
from factmill.sources import files
from factmill.streaming import incremental


def test_decode_text():
    assert files.decode_text(b"\xef\xbb\xbfa\r\nb\rc\x0cd") == "a\nb\nc\x0cd"
    assert files.decode_text(b"caf\xe9 \x93q\x94") == "café “q”"
    assert files.decode_text(b"\x81") == "\x81"


def test_read_books(spark, tmp_path):
    (tmp_path / "my_book.txt").write_bytes("Title: Old Days\r\n*** START OF THE PROJECT GUTENBERG EBOOK X ***\r\nbody\r\n*** END OF THE PROJECT GUTENBERG EBOOK".encode())
    rows = files.read_books(spark, str(tmp_path / "*.txt"))
    r = rows.select("book_id", files.detect_title("text", "book_id").alias("t"), files.strip_boilerplate("text").alias("b")).first()
    assert tuple(r) == ("my_book", "Old Days", "body")
    (tmp_path / "blank.txt").write_bytes(b" \n")
    with pytest.raises(Exception, match="blank book"):
        files.read_books(spark, str(tmp_path / "blank.txt")).collect()


def test_json_files(tmp_path):
    p = str(tmp_path / "a.json")
    assert files.load_json(p, {"d": 1}) == {"d": 1}
    with pytest.raises(FileNotFoundError):
        files.load_json(p, required=True)
    (tmp_path / "a.json").write_text('{"a": [1, 2,], // note\n "b": "x // , ]"}')
    assert files.load_json(p) == {"a": [1, 2], "b": "x // , ]"}
    assert files.update_results(p, {"b": 2, "c": "é"}) == {"a": [1, 2], "b": 2, "c": "é"}
    assert "é" in (tmp_path / "a.json").read_text("utf-8")
    first = files.backup_once(p, str(tmp_path / "raw.json"))
    files.save_json(p, {"z": 0})
    assert files.backup_once(p, str(tmp_path / "raw.json")) == first


def test_question_files(spark, tmp_path):
    (tmp_path / "t.json").write_text(json.dumps([{"id": 1, "question": "Q?", "type": "multiple_choice", "correct_answer": "A", "options": ["A) x", "B) y"]}, {"id": 2, "question": "R?", "type": "true_false", "correct_answer": "True"}]))
    rows = files.load_set(spark, "trap", traps=str(tmp_path / "t.json")).orderBy("id").collect()
    assert [(r["id"], r["question"]) for r in rows] == [("t01", "Q?\nA) x\nB) y"), ("t02", "R?")]
    bad = spark.createDataFrame([(3, "Q?", "riddle", "A", None, None, None, None)], files.TRAP_SCHEMA)
    with pytest.raises(Exception, match="bad_type"):
        files.trap_questions(spark, bad).collect()
    raw = spark.createDataFrame([(1, "Q?", "practical", "U", ["u0001", "u0009"], "t")], files.PRACTICAL_SCHEMA)
    have = spark.createDataFrame([("u0001",)], "id string")
    rows, missing = files.practical_questions(spark, raw, have)
    assert rows.first()["id"] == "p01" and [r["unit_id"] for r in missing.collect()] == ["u0009"]
    assert files.practical_questions(spark, raw, have.limit(0))[1].collect() == [] and files.practical_questions(spark, raw)[1].collect() == []
    with pytest.raises(ValueError):
        files.parse_sets("knowledge,other")


def test_resume_rules(spark):
    q = spark.createDataFrame([("1", "a"), ("2", "b"), ("3", "c"), ("4", "d")], "id string, question string")
    done = spark.createDataFrame([("1", "a", "run", None), ("2", "changed", "run", None), ("3", "c", "run", "failed"), ("4", "d", "other", None)], "id string, question string, label string, error string")
    assert sorted(r["id"] for r in incremental.pending(q, done, "run").collect()) == ["2", "3", "4"]
    judged = done.withColumn("fingerprint", incremental.run_fingerprint("j", 1, ["a"], 4))
    assert incremental.pending_items(q, judged, incremental.run_fingerprint("j", 1, ["a"], 4)).count() == 0
    assert incremental.pending_items(q, judged, incremental.run_fingerprint("j", 2, ["a"], 4)).count() == 4


def test_loss_stream_equals_batch(spark, small, tmp_path):
    events = spark.read.parquet(f"{small}/events.parquet")
    events.write.parquet(str(tmp_path / "in"))
    stream = incremental.loss_stream(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")))
    stream.writeStream.format("memory").queryName("losses").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    got = spark.table("losses").select("start", "event_type", "n").collect()
    want = incremental.loss_stream(events).select("start", "event_type", "n").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and got


def test_resumed_stream_adds_nothing_twice(spark, tmp_path):
    spark.sql("DROP TABLE IF EXISTS streamed")
    q = spark.createDataFrame([("1", "a"), ("2", "b")], "id string, question string")
    q.write.mode("append").parquet(str(tmp_path / "q"))
    answer = lambda df: df.withColumn("error", F.lit(None).cast("string"))
    for n, more in enumerate([[], [("2", "b"), ("3", "c")]]):
        if more:
            spark.createDataFrame(more, q.schema).write.mode("append").parquet(str(tmp_path / "q"))
        source = spark.readStream.schema(q.schema).parquet(str(tmp_path / "q"))
        incremental.resume_stream(source, "streamed", "run", answer, str(tmp_path / "ckpt")).awaitTermination()
    assert sorted(r["id"] for r in spark.table("streamed").collect()) == ["1", "2", "3"]


def questions(spark, rows):
    return spark.createDataFrame([(i, s, t, q, r, [], None) for i, s, t, q, r in rows], "id string, set string, type string, question string, reference_answer string, aliases array<string>, options array<string>")


def test_stages_and_blind_evaluation(spark):
    spark.sql("DROP TABLE IF EXISTS runs")
    rows = [("q001", "knowledge", "factual", "Who built Venice", "Venice"), ("q002", "knowledge", "factual", "Say nothing", "Rome"), ("t01", "trap", "true_false", "Is it True", "True")]
    q = questions(spark, rows)
    base, summary, verdict = pipelines.evaluate_stage(spark, q, "runs", "baseline", backends.Stub)
    assert verdict == "PASS" and {r["id"]: r["is_correct"] for r in base.collect()} == {"q001": 1, "q002": 0, "t01": 1}
    n = spark.table("runs").count()
    pipelines.evaluate_stage(spark, q, "runs", "baseline", backends.Stub)
    assert spark.table("runs").count() == n
    trained, _, verdict = pipelines.evaluate_stage(spark, q, "runs", "trained", backends.Stub)
    assert verdict == "FAIL"
    pooled = base.withColumn("source", F.lit("baseline")).unionByName(trained.withColumn("source", F.lit("trained")))
    pooled = pooled.withColumnRenamed("id", "question_id").withColumn("passage", F.lit(""))
    judgments, counts, metrics = pipelines.evaluate_blind(spark, pooled, backends.Stub, "judge-x", "model-y")
    assert judgments.count() == 6 and counts.agg(F.sum("total")).first()[0] == 6
    m = metrics.first()
    assert m["after_total"] == 2 and m["sets_present"] == "knowledge,trap" and m["refusals_of"].endswith("/15")
    with pytest.raises(ValueError):
        pipelines.evaluate_blind(spark, pooled, backends.Stub, "big-model-y-judge", "model-y")


def test_errors_stop_a_run_and_are_retried(spark):
    class Echo(backends.Stub):  # local, so that workers get it by value
        def generate(self, prompts, max_new_tokens):
            raise RuntimeError("boom")

    spark.sql("DROP TABLE IF EXISTS failing")
    q = questions(spark, [("q001", "knowledge", "factual", "boom", "x")])
    with pytest.raises(RuntimeError):
        incremental.evaluate(spark, q, "failing", "run", Echo)
    assert incremental.evaluate(spark, q, "failing", "run", backends.Stub).count() == 1


def test_same_questions_and_replay(spark):
    a = spark.createDataFrame([("1", 1), ("2", 2)], "id string, n int")
    assert exam.same_questions(a, a.orderBy(F.desc("id"))) and not exam.same_questions(a, a.limit(1))
    results = spark.createDataFrame([("1", "factual", "Q?", "A")], "id string, type string, question string, reference_answer string")
    full = spark.createDataFrame([("1", "Q!", "A", ["B"], "P")], "id string, question string, answer string, aliases array<string>, source_passage string")
    with pytest.raises(ValueError):
        exam.replay_questions(results, full)
    assert exam.replay_questions(results, full.withColumn("question", F.lit("Q?"))).first()["source_passage"] == "P"


def test_build_units_of_a_book(spark):
    names = [f"{a}{b}" for a in ("Ven", "Mil", "Tor", "Gen", "Par", "Nap") for b in ("ice", "ano", "ino", "oa", "ma", "les")]
    paras = [f"The old harbour town near {n} has many tall white towers there. It was a place known to all the people. They went to the market on every day." for n in names]
    text = "\n\n".join(f"CHAPTER {c}\n\n" + "\n\n".join(paras[c * 12 : c * 12 + 12]) for c in range(3))
    books = spark.createDataFrame([("b", text)], "book_id string, text string")
    units, rejected, meta = pipelines.build_units(books, 300, least_units=30, least_chars=1000)
    rows = units.collect()
    assert len(rows) >= 30 and sorted(r["id"] for r in rows)[0] == "u0001" and rejected.count() == 0
    m = meta.first()
    assert {r["key_term"] for r in rows} <= set(names) and (m["chapters"], m["units"], m["title"], m["source_file"], m["characters"]) == (3, len(rows), "B", "b", len(text))
    assert m["page_numbering"] == "estimated_1800_chars_per_page" and m["candidates"] >= len(rows) and m["sentences"] == 108
    for wrong in ({"target": 10}, {"target": 300, "least_units": 30}, {"target": 300, "least_chars": 1000}):
        with pytest.raises(ValueError):
            pipelines.build_units(books, **wrong)
    dropped = units.withColumn("fact", F.when(F.col("id") == "u0001", F.concat("fact", F.lit(" It was corrected to this."))).otherwise(F.col("fact")))
    cleaned, report = pipelines.clean_units(dropped, books, meta, len(rows))
    got = {r["id"]: r for r in cleaned.collect()}
    assert report.filter("action = 'dropped'").count() == 1 and "u0001" not in got
    assert all(r["link"].count(":") == 1 for r in got.values())


def test_page_size_of_a_method(spark):
    df = spark.createDataFrame([("estimated_1500_chars_per_page",), ("form_feed",), (None,)], "m string")
    assert [r[0] for r in df.select(files.page_size("m")).collect()] == [1500, None, None]


def test_extra_sets_need_the_same_questions(spark):
    spark.sql("DROP TABLE IF EXISTS extra")
    q = questions(spark, [("t01", "trap", "true_false", "Is it True", "True"), ("t02", "trap", "true_false", "Is it False", "False")]).withColumn("ordinal", F.col("id"))
    out = pipelines.run_extra_sets(spark, {"trap": q}, "extra", "trained", backends.Stub, {"trap": q})
    assert out["trap"].count() == 2
    with pytest.raises(ValueError):
        pipelines.run_extra_sets(spark, {"trap": q}, "extra", "trained", backends.Stub, {"trap": q.limit(1)})


def test_numbered_rows_and_large_permutations(spark, monkeypatch):
    from factmill.session import number_rows

    df = spark.range(1000).withColumn("k", F.xxhash64("id"))
    rows, n = number_rows(df.repartition(7), [F.desc("k")], "n")
    want = sorted(((r["k"], r["id"]) for r in df.collect()), reverse=True)
    assert n == 1000 and [(r["k"], r["id"]) for r in rows.orderBy("n").collect()] == want and rows.agg(F.min("n"), F.max("n")).first() == (1, 1000)
    assert number_rows(df.limit(0), ["k"], "n")[1] == 0
    monkeypatch.setattr(exam, "MOST_PERMUTED", 10)
    with pytest.raises(ValueError):
        exam.permuted(df, 1, ["id"])


def test_no_single_task_window_over_records(spark, small):
    import __spark_entry__ as entry

    assert "SinglePartition" not in entry.queries()["blind_items"](spark, small)._jdf.queryExecution().executedPlan().toString()
