"""Columns of the caller whose names are those that operators work with or add, in any case of letters."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.llm import decontam, langid, mixing, suffix, toxicity, urlfilter

WORKING = ("__text", "__ID", "__block", "__letter", "__Lang", "_hit_words", "__p", "__rule", "__terms", "row", "__text_0")


@pytest.fixture(scope="module")
def frame(spark):
    rows = [(0, "katze hund maus und mehr"), (1, "lorem ipsum dolor sit amet"), (2, None), (None, ""), (0, "katze hund maus und mehr")]
    out = spark.createDataFrame(rows, "doc_id long, text string")
    for k, name in enumerate(WORKING):
        out = out.withColumn(name, F.lit(k))
    return out


def _untouched(result, n):
    rows = result.collect()
    assert len(rows) == n and [c for c in result.columns if c in WORKING] == list(WORKING)
    assert all([r[name] for name in WORKING] == list(range(len(WORKING))) for r in rows)
    return rows


def test_decontamination(spark, frame):
    items = spark.createDataFrame([("i", "katze hund maus und mehr")], "item_id string, text string")
    rows = _untouched(decontam.find_phrases(frame.withColumn("N_HIT", F.lit("q")), items), 5)
    assert sorted(r["n_hit"] for r in rows) == [0, 0, 0, 5, 5]


def test_suffix_dedup(frame):
    rows = _untouched(suffix.remove_repeats(frame.withColumn("N_Bytes", F.lit("q"))), 5)
    assert sorted(r["n_bytes"] for r in rows) == [0, 0, 24, 24, 26]


def test_language_id(frame):
    labelled = frame.withColumn("lang", F.when(F.col("text").startswith("k"), "de").otherwise("la"))
    result = langid.identify(labelled.withColumn("Margin", F.lit("q")).withColumn("SCORE", F.lit("q")), F.lit(True))
    assert {type(r["margin"]) for r in _untouched(result, 5)} == {float} and len({c.lower() for c in result.columns}) == len(result.columns)


def test_toxicity(frame):
    model = toxicity.Model(np.zeros(toxicity.BUCKETS, dtype=np.float32), 0.0)
    result = toxicity.score(frame.withColumn("Score", F.lit("q")).withColumn("PREDICTED", F.lit("q")), model)
    assert {r["score"] for r in _untouched(result, 5)} == {0.5} and "Score" not in result.columns


def test_url_filter(spark, frame):
    pages = frame.withColumn("url", F.lit("http://a.example.org/es/1")).withColumn("Verdict", F.lit("q"))
    assert {r["verdict"] for r in _untouched(urlfilter.judge(pages, urlfilter.labelled_urls(spark)), 5)} == {"block"}


def test_mixing(frame):
    result = mixing.mix(frame.withColumn("source", F.lit("s")).withColumn("SIZE", F.lit("q")).withColumn("Taken", F.lit("q")))
    assert sorted(r["size"] for r in _untouched(result, 5)) == [0, 0, 5, 5, 5] and "SIZE" not in result.columns


def test_names_of_parameters_may_clash(frame):
    marked = toxicity.score(frame.drop("__text").withColumnRenamed("text", "__text"), toxicity.Model(np.zeros(toxicity.BUCKETS, dtype=np.float32), 0.0), text="__text")
    assert sum(r["__text"] is None for r in marked.collect()) == 1
    named = frame.drop("__text", "__ID").withColumnRenamed("text", "__text").withColumnRenamed("doc_id", "__id")
    cut = suffix.remove_repeats(named, doc_id="__id", text="__text")
    assert sorted(r["n_bytes"] for r in cut.collect()) == [0, 0, 24, 24, 26] and "__id" in cut.columns
