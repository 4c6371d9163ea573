"""SQL functions against the column expressions that they stand for."""

import pytest
from pyspark.sql import functions as F

from corvane.functions import sql
from corvane.functions import text as tx
from corvane.operators import det, transcripts
from corvane.sources import tables

TEXTS = ['"a (b) 12"', '"', "", None, "  x\t y ", "100 apples, 101 and 012 (x", '"(gone)"', "é19é 19é 19", "10-11_12 13"]


def test_text_functions(spark):
    sql.register(spark)
    frame = spark.createDataFrame([(k, t) for k, t in enumerate(TEXTS)], "k int, x string")
    pairs = {
        "strip_outer_quotes(x)": tx.strip_outer_quotes(F.col("x")), "strip_parentheses(x)": tx.strip_parentheses(F.col("x")), "collapse_blanks(x)": tx.collapse_blanks(F.col("x")),
        "expand_numbers(x, number_words())": tx.expand_numbers(F.col("x"), tx.number_words()), "clean_transcript(x)": tx.clean(F.col("x")),
        "is_digit_entry(x)": transcripts.is_digit_entry(F.col("x")), "excluded_source(x, array('a', '10'))": tx.excluded_source(F.col("x"), ("a", "10")),
    }
    for text, column in pairs.items():
        assert frame.where(~F.expr(text).eqNullSafe(column)).count() == 0, text


def test_other_functions(spark):
    sql.register(spark)
    frame = spark.createDataFrame([(v,) for v in (None, -1.0, 0.0, 4.9, 5.0, 7.0, 9.0, 100.0)], "v double")
    same = tx.duration_bucket(F.col("v"), (0.0, 5.0, 9.0), ("a", "b", "c", "d"))
    assert frame.where(~F.expr("duration_bucket(v, array(0D, 5D, 9D), array('a', 'b', 'c', 'd'))").eqNullSafe(same)).count() == 0
    assert frame.where(~F.expr("decibel(v)").eqNullSafe(tx.decibel(F.col("v")))).count() == 0
    assert frame.where(~F.expr("shortcut_verdict(v / 10)").eqNullSafe(det.verdict(F.col("v") / 10))).count() == 0
    labels = spark.createDataFrame([(x,) for x in (" Bonafide", "SPOOF", "1", "0.0", "1.0 ")], "x string")
    assert labels.where(~F.expr("label_to_binary(x)").eqNullSafe(tables.label_to_binary(F.col("x")))).count() == 0
    with pytest.raises(Exception, match="unknown label"):
        spark.sql("SELECT label_to_binary('maybe')").collect()


def test_results_by_table_function(spark):
    rows = [(k, float(k % 10), k % 3 == 0, None if k % 3 == 0 else "ab"[k % 2]) for k in range(60)]
    scored = spark.createDataFrame(rows, "id long, score double, bona boolean, system string")
    sql.result_views(spark, scored, prefix="mine")
    want = {tuple(r) for r in det.system_confusion(scored, "system", spark.createDataFrame([("a", 4.0), ("b", 4.0)], "system string, threshold double")).select("system", "tp", "fp", "tn", "fn").collect()}
    assert {tuple(r) for r in spark.sql("SELECT * FROM mine_confusion(4.0)").collect()} == want
    assert spark.sql("SELECT system FROM mine_rates").count() == 2
