"""Texts in a language that was not learned are rejected, those in learned ones are kept."""

import os

import pytest
from pyspark.sql import functions as F

from factmill.llm import language
from factmill.llm.common import crc_mod, read

DATA = os.environ.get("TEST_DATA", "/root/testdata")


@pytest.mark.parametrize("left_out", ["de", "en", "es", "fr"])
def test_left_out_language_is_rejected(spark, left_out):
    docs = read(spark, f"{DATA}/sf0.1", "documents")
    model = language.fit(docs.filter((crc_mod("doc_id", 5) != 0) & (F.col("lang") != left_out)))
    held = docs.filter(crc_mod("doc_id", 5) == 0)
    share = {r.new: r.share for r in language.identify(held, model, keep=("lang",)).groupBy((F.col("lang") == left_out).alias("new")).agg(F.avg(F.col("rejected").cast("int")).alias("share")).collect()}
    print(left_out, share)
    assert share[True] > 0.9 and share[False] < 0.04


def test_outliers_get_no_centroid_of_their_own():
    texts = [f"the cat and the dog went to the house number {'abcdefghij'[i % 10]}" for i in range(40)]
    model = language.Model([*texts, "zq zq zq"], ["en"] * 41)
    assert model.predict(["qzx jqv wqz"])[0][2] and not model.predict(texts[:1])[0][2]
