"""Readers, sinks, joins and audio definitions on small files."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.functions import audio
from corvane.functions import text as tx
from corvane.operators import attach, audit, splits, vectors
from corvane.sources import logs, sinks, tables


def _file(folder, name, text):
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    return str(path)


def test_prediction_files(spark, tmp_path):
    head = "ID_audio,label,score_class0,score_class1\n"
    with pytest.raises(ValueError, match="header"):
        logs.predictions(spark, _file(tmp_path, "a.txt", "x,1,0,1\ny,0,0,1\n"))
    with pytest.raises(ValueError, match="both classes"):
        logs.predictions(spark, _file(tmp_path, "b.txt", head + "x,1,0,1\n"))
    with pytest.raises(Exception, match="four fields"):
        logs.predictions(spark, _file(tmp_path, "c.txt", head + "x,1,0,1\ny,0,0,1\nz,0\n")).collect()
    rows = tables.predictions_csv(spark, _file(tmp_path, "d.csv", "label,ID_audio,score_class1\n Spoof ,007,0.25\n1,b,0.5\n")).collect()
    assert sorted(map(tuple, rows)) == [("007", 0, 0.25), ("b", 1, 0.5)]
    with pytest.raises(ValueError, match="score_class1"):
        tables.predictions_csv(spark, _file(tmp_path, "e.csv", "label,ID_audio\n1,b\n"))
    with pytest.raises(Exception, match="unknown label"):
        spark.createDataFrame([("maybe",)], "l string").select(tables.label_to_binary(F.col("l"))).collect()


def test_speaker_lists_maps_and_targets(spark, tmp_path):
    speakers = tables.speaker_list(spark, _file(tmp_path, "s.csv", "\ufeffgender,speaker_id\nF,0200\nM,0100\nF,0200\nF,\n")).orderBy("place").collect()
    assert [r["speaker"] for r in speakers] == ["0200", "0100"]
    path = _file(tmp_path, "kv/a.txt", "s1 - v - 1\nbroken\ns2 - x\ns1 - v2\n")
    assert {r["key"]: r["value"] for r in tables.key_values(spark, path).collect()} == {"s1": "v2", "s2": "x"}
    sinks.append_key_values(spark.createDataFrame([("s3", "new")], "key string, value string"), str(tmp_path / "kv"))
    assert {r["key"] for r in tables.key_values(spark, str(tmp_path / "kv")).collect()} == {"s1", "s2", "s3"}
    rows = tables.tsv_targets(spark, _file(tmp_path, "t.tsv", "a\tb\tc\td\n1\tf\tt\tr\n1\tf\tt\n\n2\t\tt\tr\n")).orderBy("line").collect()
    assert [r["error"] for r in rows] == [None, "not four fields", "empty field"] and rows[0]["speaker"] == "1"
    texts = tables.transcripts(spark, _file(tmp_path, "tr/0007.txt", "a.wav\tone\ttwo\nb.wav\t \nc.wav\n")).collect()
    assert [tuple(r) for r in texts] == [("0007", "a.wav", "one\ttwo")]
    assert [r["duration_sec"] for r in tables.durations_jsonl(spark, _file(tmp_path, "d.jsonl", '{"audio_filepath": "a", "duration_sec": 1.5}\n')).collect()] == [1.5]
    digits = tables.digit_map(spark, _file(tmp_path, "d.tsv", "wav_filename\tdigit\tsaying\na.wav\t1\tisa\na.wav\t1\tuno\nb.wav\t2\t\n")).collect()
    assert [tuple(r) for r in digits] == [("a.wav", "1", "isa", 1)]
    assert tables.number_map(spark, _file(tmp_path, "n.json", '{"10": "ten",\n "11": "eleven"}')) == {10: "ten", 11: "eleven"}
    with pytest.raises(ValueError):
        tables.number_map(spark, _file(tmp_path, "m.json", "[1]"))


def test_log_headers_and_quote_split(spark, tmp_path):
    path = _file(tmp_path, "l/a.log", 'Gender = "f"\nDialect = north\nGender = "a"\na.wav " src " "t"\nx.wav = "b" "c"\n')
    lines = tables.numbered_lines(spark, path)
    row = logs.header_fields(lines, ["Gender", "Dialect"]).first()
    assert (row["Gender"], row["Dialect"]) == ("a", "north")
    got = [r[0] for r in lines.orderBy("line").select(logs.quote_split(F.col("value"))).collect()]
    assert got[3]["source"] == "src" and got[4] is None and got[0] is None
    found = tables.find_log(spark, str(tmp_path / "l")).first()
    assert found["logs"] == 1 and found["log"].endswith("a.log")


def test_audio_tree_inventory_and_sink(spark, tmp_path):
    tone = audio.encode(np.sin(np.arange(16000) / 5) * 0.5)
    rows = spark.createDataFrame([(f"s{k % 2}/d/c{k}.wav", bytearray(tone)) for k in range(5)] + [("s0/bad.wav", bytearray(b"junk")), ("s0/x.txt", bytearray(b"t"))], "path string, content binary")
    out = sinks.write_audio(rows, f"file://{tmp_path}/tree").collect()
    assert len(out) == 7 and not any(r["error"] for r in out)
    tree = tables.audio_tree(spark, f"file://{tmp_path}/tree", "spoof", "tts", most_per_speaker=2).collect()
    assert sorted((r["speaker_id"], r["id"]) for r in tree) == [("s0", "bad"), ("s0", "c0"), ("s1", "c1"), ("s1", "c3")] and {r["spoof_method"] for r in tree} == {"tts"}
    held = {r["id"]: r for r in tables.audio_inventory(spark, f"file://{tmp_path}/tree").collect()}
    assert len(held) == 6 and held["c0"]["valid"] and held["c0"]["duration_sec"] == 1.0 and held["bad"]["error"] and not held["bad"]["valid"]
    for kind in ("csv", "tsv", "json"):
        sinks.write_report(spark.createDataFrame([("007", 1)], "a string, b int"), str(tmp_path / kind), kind)
    assert spark.read.option("header", True).option("sep", "\t").csv(str(tmp_path / "tsv")).first()["a"] == "007"
    with pytest.raises(ValueError):
        sinks.write_report(rows, str(tmp_path / "no"), "xml")


def test_long_silent_clips_are_not_held(spark, tmp_path):
    """Eighty clips of some 40 MB: more than one Arrow array of bytes can hold."""
    from corvane.plans import signals

    spark.range(600_000, 600_080).selectExpr("id as s_suppkey", "cast(id % 8 as int) as s_nationkey").coalesce(1).write.parquet(f"{tmp_path}/supplier.parquet")
    got = {r["id"]: r for r in signals.audio_header_scan(spark, str(tmp_path)).collect()}
    assert sorted(got) == sorted(str(k) for k in range(600_000, 600_080) if k % 8 in (1, 3, 7))
    for name, r in got.items():
        key = int(name)
        rate = (8000, 16000, 44100)[key % 3]
        assert (r["sample_rate"], r["channels"], r["valid"]) == (rate, 1 + key % 2, True) and abs(r["duration_sec"] - (400 + 16 * key) / rate) < 0.001


def test_zeros_after_the_content(spark, tmp_path):
    rows = spark.createDataFrame([("a/x.bin", bytearray(b"ab"), 5), ("a/y.bin", bytearray(b"c"), None)], "path string, content binary, zeros long")
    out = {r["path"]: r["bytes"] for r in sinks.write_audio(rows, f"file://{tmp_path}/z", zeros="zeros").collect()}
    assert out == {"a/x.bin": 7, "a/y.bin": 1}
    assert (tmp_path / "z/a/x.bin").read_bytes() == b"ab" + bytes(5) and (tmp_path / "z/a/y.bin").read_bytes() == b"c"


def test_audio_definitions():
    n = np.arange(16000)
    tone = np.concatenate([np.zeros(1600), 0.5 * np.sin(2 * np.pi * 1000 * (n + 0.5) / 16000), np.zeros(800)])
    got = audio.describe(tone, 16000)
    assert got["lead_silence_s"] == 0.1 and got["trail_silence_s"] == 0.05 and got["duration_s"] == len(tone) / 16000
    assert abs(got["peak_db"] - 20 * np.log10(np.abs(tone).max())) < 1e-9 and abs(got["rms_db"] - 10 * np.log10(np.mean(tone**2))) < 1e-9
    assert abs(got["rolloff_95_hz"] - 1000) < 40 and got["hf_ratio_7k"] < 1e-6
    frames = [np.sqrt(np.mean(tone[k : k + 400] ** 2)) for k in range(0, len(tone) - 399, 160)]
    low, high = (20 * np.log10(max(v, 1e-10)) for v in np.percentile(frames, [10, 95]))
    assert abs(got["noise_floor_db"] - low) < 1e-9 and abs(got["dyn_range_db"] - (high - low)) < 1e-9
    with pytest.raises(ValueError):
        audio.describe(np.ones(399), 16000)


@pytest.mark.parametrize("total", range(1, 13))
def test_quotas_come_to_the_total(total):
    counts = {"short": 100, "medium": 100, "long": 100}
    due = splits.quotas(counts, {"short": 0.25, "medium": 0.5, "long": 0.25}, total)
    assert sum(due.values()) == total and due["short"] == round(total * 0.25) and due["medium"] == round(total * 0.5)
    few = splits.quotas({"short": 1, "medium": 2, "long": 50}, {"short": 0.25, "medium": 0.5, "long": 0.25}, total)
    assert sum(few.values()) == total and few["short"] <= 1 and few["medium"] <= 2


def test_attach(spark):
    manifest = spark.createDataFrame([("a.1", "s1"), ("b", "s2")], "id string, speaker string")
    found = attach.attach_speaker(spark.createDataFrame([("a.1",), ("x/b.2",)], "id string"), manifest).collect()
    assert sorted((r["id"], r["speaker"]) for r in found) == [("a.1", "s1"), ("x/b.2", "s2")]
    with pytest.raises(Exception, match="no speaker"):
        attach.attach_speaker(spark.createDataFrame([("none",)], "id string"), manifest).collect()
    found = attach.systems(spark.createDataFrame([("b",), ("none",), ("a",), (None,), ("a",)], "method string"))
    assert sorted(r["method"] for r in found.collect()) == ["a", "b"]
    words = spark.createDataFrame([("x12 12 \u00e913 14\u00e9 15",)], "t string")
    assert words.select(tx.whole_numbers(F.col("t"))).first()[0] == ["12", "15"]
    assert words.select(tx.expand_numbers(F.col("t"), {12: "twelve", 13: "-", 14: "-"})).first()[0] == "x12 twelve \u00e913 14\u00e9 15"


def test_derived_configs():
    base = {"model": {"dim": 1}, "test": {"files": ["a"]}}
    assert audit.derived_config(base, {"test.files": ["b"]}, ("test",)) == {"model": {"dim": 1}, "test": {"files": ["b"]}} and base["test"]["files"] == ["a"]
    with pytest.raises(ValueError, match="model.dim"):
        audit.derived_config(base, {"model.dim": 2}, ("test",))
    with pytest.raises(ValueError, match="nothing"):
        audit.derived_config(base, {"test.files": ["a"]}, ("test",))


@pytest.mark.parametrize("rate", [8000, 22050, 44100, 48000])
def test_polyphase_keeps_a_tone(rate):
    x = np.sin(2 * np.pi * 1000 * np.arange(rate) / rate)
    y = audio.resample_polyphase(x, rate)
    want = np.sin(2 * np.pi * 1000 * np.arange(len(y)) / 16000)
    assert abs(len(y) - 16000) <= 1 and np.abs(y - want)[400:-400].max() < 0.01
    assert np.abs(audio.resample_polyphase(np.ones(rate), rate)[400:-400] - 1).max() < 1e-3
    if rate > 32000:  # what the new rate cannot hold goes
        assert np.abs(audio.resample_polyphase(np.sin(2 * np.pi * 12000 * np.arange(rate) / rate), rate)[400:-400]).max() < 0.02


def test_cached_features_transforms_and_voices(spark, tmp_path):
    tone = lambda hz: bytearray(audio.encode(np.sin(2 * np.pi * hz * np.arange(16000) / 16000) * 0.25))
    frame = lambda *hz: spark.createDataFrame([(f"p{k}", "ab"[k % 2], tone(f)) for k, f in enumerate(hz)], "path string, voice string, content binary")
    folder = str(tmp_path / "cache")
    assert audio.cached_features(frame(300, 400), folder).count() == 2
    # the bytes of a known path are not read again
    again = {r["path"]: r for r in audio.cached_features(frame(3000, 400, 500), folder).collect()}
    assert len(again) == 3 and again["p0"]["rolloff_95_hz"] < 400 and spark.read.parquet(folder).count() == 3
    voices = vectors.voice_centroids(spark.createDataFrame([(r["voice"], r["mfcc"]) for r in again.values()] + [("a", None)], "voice string, mfcc array<double>"), ["voice"]).collect()
    assert sorted(r["voice"] for r in voices) == ["a", "b"] and all(abs(sum(x * x for x in r["centroid"]) - 1) < 1e-9 for r in voices)

    @audio.register("halve")
    def halve(x):
        return x / 2

    out = audio.transform(frame(300).union(spark.createDataFrame([("bad", "a", bytearray(b"junk"))], "path string, voice string, content binary")), ["trim", "peak", "halve"])
    got = {r["path"]: r for r in out.collect()}
    assert abs(np.abs(audio.decode(got["p0"]["content"])[0]).max() - 0.475) < 0.01 and got["bad"]["error"] and got["bad"]["content"] is None
    with pytest.raises(ValueError, match="unknown"):
        audio.transform(frame(300), ["no"])


def test_name_and_path():
    assert tables.name_and_path("tts=/a/b=c") == ("tts", "/a/b=c")
    for wrong in ("tts", "=x", "x="):
        with pytest.raises(ValueError):
            tables.name_and_path(wrong)


@pytest.mark.parametrize("sizes", [{}, {"block_names": 3, "chunk_lines": 4}])
def test_transcripts_by_the_first_line_that_contains_the_name(spark, sizes):
    lines = [(s, k, v) for s, own in {
        "a": ["", "a.12.wav\tone two ", "  see a.1.wav here", "a.1.wav\tlater", "b.9.wav x", None, "(a.3+.wav", "aa.12.wav\tno"],
        "b": ["a.1.wav\tanother speaker", "b.9.wav\tb.9.wav"],
        "hot": [f"hot.{k % 40}.wav\tline {k}" for k in range(200)],
    }.items() for k, v in enumerate(own)]
    files = [("a", "a.12.1.wav"), ("a", "a.12.2.wav"), ("a", "a.1.wav"), ("a", "a.3+.2.wav"), ("a", "2.wav"), ("a", "b.9.wav"), ("a", "x.wav"), ("b", "a.1.1.wav"), ("c", "c.wav"), ("a", None), (None, "a.1.wav")]
    files += [("hot", f"hot.{k}.1.wav") for k in range(45)] + [("a", "a.1.wav")]
    got = attach.attach_transcript(spark.createDataFrame(files, "speaker string, file string"), spark.createDataFrame(lines, "speaker string, line int, value string").repartition(3), **sizes)

    def want(speaker, file):
        name = file and (file[:-6] + ".wav" if file.endswith((".1.wav", ".2.wav")) else file)
        return next((v.strip() for s, _, v in lines if s == speaker and name is not None and v is not None and name in v), "")

    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(repr((s, f, want(s, f))) for s, f in files)


def test_log_lines_in_sql_keep_bad_lines(spark):
    from corvane.sources import log_function

    log_function.register(spark)
    rows = [("a", 1, 'Name = "Ann Lee"'), ("a", 2, ""), ("a", 3, None), ("a", 4, 'x.wav "src 1" "some (text)"'), ("a", 5, "what is this"), ("a", 6, 'y.wav "k=v" more'), (None, 7, '"q.wav" = 3'), ("b", 8, "z.wav   \"s\"  plain"), ("b", 9, " = x"), ("b", 10, "é.wav \"\" t")]
    spark.createDataFrame(rows, "log string, line long, value string").createOrReplaceTempView("some_lines")
    got = {r["line"]: tuple(r) for r in spark.sql("SELECT * FROM log_lines(TABLE(SELECT log, line, value FROM some_lines))").collect()}
    assert got == {
        1: ("a", 1, "header", "Name", None, "Ann Lee"), 4: ("a", 4, "utterance", "x.wav", "src 1", '"some (text)"'), 5: ("a", 5, "bad", None, None, "what is this"),
        6: ("a", 6, "header", 'y.wav "k', None, 'v" more'), 7: (None, 7, "bad", None, None, '"q.wav" = 3'), 8: ("b", 8, "utterance", "z.wav", "s", "plain"),
        9: ("b", 9, "header", " ", None, "x"), 10: ("b", 10, "utterance", "é.wav", "", "t"),
    }
    # the column expression says the same of each line
    same = spark.table("some_lines").select("line", logs.utterances(F.col("value")).alias("u")).where("u is not null").collect()
    assert {r["line"]: tuple(r["u"]) for r in same} == {k: v[3:] for k, v in got.items() if v[2] == "utterance"}
    assert spark.sql("SELECT * FROM log_lines(TABLE(SELECT log, line, value FROM some_lines WHERE false))").count() == 0


class _Counted:
    def __init__(self, raw):
        self.raw, self.read, self.asked = raw, 0, 0

    def read_at(self, n, offset):
        self.asked += n
        return self.raw[offset : offset + n]


def _wave(frames, channels=1, width=2, rate=16000, extra=b""):
    import struct

    form = struct.pack("<HHIIHH", 1, channels, rate, rate * channels * width, channels * width, 8 * width)
    body = b"WAVE" + extra + b"fmt " + struct.pack("<I", len(form)) + form + b"data" + struct.pack("<I", frames * channels * width) + bytes(frames * channels * width)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def test_headers_are_read_by_ranges_whatever_the_length():
    import struct

    from corvane.sources import audio_headers

    asked = set()
    for frames in (160, 1_600_000):
        file = _Counted(_wave(frames, extra=b"LIST" + struct.pack("<I", 5) + b"abcde\0"))
        got = audio_headers.header(file, len(file.raw))
        asked.add(file.asked)
        assert got == {"container": "WAV", "subtype": "PCM_16", "sample_rate": 16000, "channels": 1, "duration_sec": frames / 16000, "valid": True}
    assert len(asked) == 1 and asked.pop() < 100
    bits = (44100 << 44) | (1 << 41) | (23 << 36) | 88200
    flac = b"fLaC" + bytes([0, 0, 0, 34]) + bytes(10) + bits.to_bytes(8, "big") + bytes(16)
    assert audio_headers.header(_Counted(flac), len(flac)) == {"container": "FLAC", "subtype": "PCM_24", "sample_rate": 44100, "channels": 2, "duration_sec": 2.0, "valid": True}
    for raw in (b"", b"junk", b"RIFF\0\0\0\0WAVE", b"fLaC", _wave(0)[:30]):
        got = audio_headers.header(_Counted(raw), len(raw))
        assert not got["valid"] and got["error"]
    assert audio_headers.header(_Counted(_wave(0)), len(_wave(0)))["valid"] is False


def test_audio_headers_prune_folders_and_warn_of_a_missing_root(spark, tmp_path):
    from pyspark.sql.datasource import EqualTo, GreaterThan, In

    from corvane.sources import audio_headers

    for speaker in ("a", "b", "c"):
        (tmp_path / speaker / "deep").mkdir(parents=True)
        (tmp_path / speaker / "deep" / "x.1.WAV").write_bytes(_wave(16, channels=2))
    (tmp_path / "top.wav").write_bytes(_wave(16))
    reader = audio_headers._Reader({"path": str(tmp_path), "foldersPerPartition": "1"})
    other = GreaterThan(("speaker_id",), "a")
    assert list(reader.pushFilters([In(("speaker_id",), ("a", "c", "z")), other, EqualTo(("speaker_id",), "c")])) == [other]
    assert [p.folders for p in reader.partitions()] == [[str(tmp_path / "c")]]
    rows = audio_headers.audio_headers(spark, str(tmp_path), foldersPerPartition=2)
    assert sorted((r["speaker_id"], r["id"], r["channels"]) for r in rows.collect()) == [(s, "x.1", 2) for s in "abc"]
    assert rows.where("speaker_id = 'b'").count() == 1 and rows.where("speaker_id in ('b', 'q') and channels = 1").count() == 0
    with pytest.warns(UserWarning, match="no folder"):
        assert audio_headers._Reader({"path": f"{tmp_path}/none"}).partitions()[0].folders == []
    assert audio_headers.audio_headers(spark, f"{tmp_path}/none").count() == 0
    with pytest.warns(UserWarning, match="no folder"):
        tree = tables.audio_tree(spark, f"{tmp_path}/none", "spoof")
    assert tree.count() == 0 and tree.columns == ["id", "path", "label", "speaker_id", "spoof_method"]


def test_sets_are_compared_by_digests(spark):
    a = spark.createDataFrame([(f"k{k}",) for k in range(300)] + [("k5",), (None,)], "id string").repartition(3)
    b = spark.createDataFrame([(f"k{k}",) for k in range(299, -1, -1)] + [(None,), (None,)], "id string")
    # another multiset of the same keys, then the same multiset in another order, then other keys
    assert attach.same_set(a, b, "id") and attach.symmetric_difference(a, b, "id").count() == 0
    assert attach._differing(a, a.orderBy(F.desc("id")), "id", 16).count() == 0 < attach._differing(a, b, "id", 16).count()
    c = b.where("id is not null and id <> 'k7'").union(spark.createDataFrame([("new",)], "id string"))
    assert {tuple(r) for r in attach.symmetric_difference(a, c, "id").collect()} == {("k7", "left"), (None, "left"), ("new", "right")}
    assert not attach.same_set(a, c, "id") and attach.same_set(a.limit(0), c.limit(0), "id")


def test_aligned_models_send_no_ids(spark):
    ids = spark.range(500)
    both = ids.withColumn("model", F.lit("a")).union(ids.withColumn("model", F.lit("b")))
    assert attach.model_alignment(both, unique=True).count() == 0
    rows = both.where("not (model = 'b' and id in (3, 77))").union(spark.createDataFrame([(900, "b")], "id long, model string"))
    want = {(3, "a", "b"), (77, "a", "b"), (900, "b", "a")}
    for unique in (True, False):
        assert {tuple(r) for r in attach.model_alignment(rows, unique=unique).collect()} == want
    twice = both.union(spark.createDataFrame([(1, "a"), (1, "b")], "id long, model string"))
    assert {tuple(r) for r in attach.model_alignment(twice).collect()} == {(1, "a,a,b,b", "")}
    assert attach.model_alignment(both.limit(0), unique=True).count() == 0
