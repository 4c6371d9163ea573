import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corvane.functions import audio
from corvane.functions import text as tx
from corvane.operators import audit
from corvane.sources import logs


def _values(spark, rows):
    return spark.createDataFrame([(r,) for r in rows], "value string")


def test_log_grammars(spark):
    rows = ['a.wav "src" "hello"', 'Key = "v"', 'b.wav "s" x = y', "", 'c.wav "Random Digit" "42"', 'd.FLAC "s" "t (u)"']
    got = [r[0] for r in _values(spark, rows).select(logs.utterances(F.col("value"))).collect()]
    assert [g and g["file"] for g in got] == ["a.wav", None, None, None, "c.wav", None]
    assert [r[0] and r[0]["number"] for r in _values(spark, rows).select(logs.random_digits(F.col("value"))).collect()][4] == 42
    assert [r[0] and r[0]["text"] for r in _values(spark, rows).select(logs.any_audio(F.col("value"))).collect()][5] == "t (u)"
    pair = _values(spark, ["s - v - w", "none"]).select(logs.key_value(F.col("value")).alias("p")).collect()
    assert pair[0]["p"]["value"] == "v - w" and pair[1]["p"] is None


def test_predictions_split_from_the_right(spark, tmp_path):
    (tmp_path / "p.txt").write_text("ID_audio,label,score_class0,score_class1\na,b,1,0.25,0.75\n\nc,0,0.5,0.5\n")
    rows = logs.predictions(spark, str(tmp_path / "p.txt")).orderBy("id").collect()
    assert [(r["id"], r["label"], r["score"]) for r in rows] == [("a,b", 1, 0.5), ("c", 0, 0.0)]


def test_clean_text(spark):
    rows = ['"say (softly) 42 times"', "  a   b ", "12 34", "x12 7"]
    got = [r[0] for r in _values(spark, rows).select(tx.clean(F.col("value"))).collect()]
    assert got == ["say forty two times", "a b", "twelve thirty four", "x12 7"]
    digits = spark.createDataFrame([("press 3", "tu\\lo $1"), ("press 3", None)], "t string, s string")
    assert [r[0] for r in digits.select(tx.expand_single_digit(F.col("t"), F.col("s"))).collect()] == ["press tu\\lo $1", "press 3"]


@settings(max_examples=20, deadline=None)
@given(st.lists(st.text(alphabet="a1209 .x", max_size=12), min_size=1, max_size=8))
def test_number_expansion_equals_one_pattern_after_another(spark, rows):
    words = tx.number_words()

    def slow(t):
        for n in sorted(words, reverse=True):
            t = re.sub(rf"\b{n}\b", words[n], t)
        return t

    got = [r[0] for r in _values(spark, rows).select(tx.expand_numbers(F.col("value"), words)).collect()]
    assert got == [slow(r) for r in rows]


def test_config_diff(spark):
    rows = audit.config_diff(spark, {"a": {"b": 1}, "c": [1]}, {"a": {"b": 2}, "d": 1}, ("a",)).orderBy("key").collect()
    assert [(r["key"], r["left_value"], r["right_value"], r["allowed"]) for r in rows] == [("a.b", "1", "2", True), ("c", "[1]", audit.ABSENT, False), ("d", audit.ABSENT, "1", False)]


def test_audio_errors_are_rows(spark):
    tone = audio.encode(np.sin(np.arange(16000) / 5) * 0.5)
    frame = spark.createDataFrame([(1, bytearray(tone)), (2, bytearray(b"junk")), (3, None), (4, bytearray(audio.encode(np.zeros(8000))))], "id long, content binary")
    rows = {r["id"]: r for r in audio.features(frame).collect()}
    assert abs(rows[1]["duration_s"] - 1) < 1e-9 and rows[1]["error"] is None and len(rows[1]["mfcc"]) == 19
    assert rows[2]["error"] and rows[3]["error"] and rows[4]["frac_exact_zero"] == 1.0
    gains = {r["id"]: r["gain_db"] for r in audio.normalise(frame).collect()}
    assert gains[4] == 0.0 and gains[1] > 0


def test_stream_counts_once(spark, tmp_path):
    from corvane.streaming import counts

    rows = spark.sql("select timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(id % 3) ts, 'a' event_type from range(9)")
    rows.write.parquet(str(tmp_path / "in"))
    out = counts.run_once(spark, str(tmp_path / "in"), rows.schema, str(tmp_path / "out"), str(tmp_path / "cp"))
    assert sorted(r["n"] for r in out.collect()) == [3, 3, 3]


def test_stream_goes_on_where_it_stopped(spark, tmp_path):
    from corvane.streaming import counts

    made = lambda n, day: spark.sql(f"select timestamp_ntz'2024-01-0{day} 00:00:00' ts, 'a' event_type from range({n})")
    run = lambda: {str(r["start"])[:10]: r["n"] for r in counts.run_once(spark, str(tmp_path / "in"), made(1, 1).schema, str(tmp_path / "out"), str(tmp_path / "cp")).collect()}
    made(4, 1).write.parquet(str(tmp_path / "in"))
    assert run() == {"2024-01-01": 4} == run()
    made(2, 1).union(made(3, 2)).write.mode("append").parquet(str(tmp_path / "in"))
    assert run() == {"2024-01-01": 6, "2024-01-02": 3}


def test_first_arrivals_on_a_stream(spark, tmp_path):
    from corvane.streaming import counts

    rows = spark.sql("select timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, id) ts, id % 3 k from range(9)")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = counts.first_arrivals(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), "k")
    stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(r["k"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [0, 1, 2]


def test_what_becomes_of_digits(spark):
    rows = [("say 3 now", "3", "tulo"), ("say 4 now", "3", "tulo"), ("say 3", "3", None), ("say 13 x3", "3", "tulo"), (None, "3", "tulo")]
    out = spark.createDataFrame(rows, "x string, digit string, saying string").select(tx.digit_outcome(F.col("x"), F.col("digit"), F.col("saying")), tx.expand_single_digit(F.col("x"), F.col("saying"))).collect()
    assert [tuple(r) for r in out] == [("replaced", "say tulo now"), ("mismatch", "say tulo now"), ("missing", "say 3"), (None, "say 13 x3"), (None, None)]
