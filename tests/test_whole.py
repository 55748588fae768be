"""Queries over whole texts: nothing of a table is lost on the way into the operators."""

import __spark_entry__ as entry


def test_every_word_is_in_an_example(spark, small):
    words = {r.doc_id: len(r.text.split()) for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    out = entry.queries()["pad_and_mask"](spark, small).collect()
    got = {}
    for r in out:
        mask, labels = r.attention_mask.split(" "), r.labels.split(" ")
        assert len(mask) == len(labels) == len(r.input_ids.split(" ")) <= 512
        got[r.doc_id] = got.get(r.doc_id, 0) + mask.count("1")
        assert any(x != "-100" for x in labels)
    assert max(words.values()) > 512 and got == {k: n for k, n in words.items() if n}


def test_blind_items_hold_whole_texts(spark, small):
    texts = sorted(r.text for r in spark.read.parquet(f"{small}/documents.parquet").select("text").collect())
    got = []
    for r in entry.queries()["blind_items"](spark, small).collect():
        got.append("\n".join([r.question, r.expected, "" if r.answer == "(no answer)" else r.answer]).rstrip("\n"))
    assert max(map(len, texts)) > 90 and sorted(got) == sorted(t.rstrip("\n") for t in texts)
