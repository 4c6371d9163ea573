"""Work that is dealt to tasks by what it costs: draws of a bootstrap, clips, files of a stream."""

import pyarrow as pa
from pyspark.sql import functions as F

from corvane.operators import attach, integrity, resample
from corvane.plans import signals


def test_draws_leave_in_bounded_batches(monkeypatch):
    monkeypatch.setattr(resample, "HELD", 1 << 14)
    rows = pa.RecordBatch.from_pydict({"stratum": ["1"] * 30, "n": [5000] * 30, "b": list(range(30)), "chunk": [0] * 30})
    out = list(resample._drawer("boot", 1000)(iter([rows])))
    sizes = [sum(map(len, batch.column("drawn").to_pylist())) for batch in out]
    assert len(out) > 5 and max(sizes) < 3 << 14
    assert sum(batch.num_rows for batch in out) == 30 * 5


def test_clips_and_lines_are_dealt_to_all_partitions(spark, tmp_path, monkeypatch):
    spark.range(40).selectExpr("id as s_suppkey", "cast(id % 5 as int) as s_nationkey").coalesce(1).write.parquet(f"{tmp_path}/supplier.parquet")
    waves = signals._waves(spark, str(tmp_path))
    assert waves.select(F.spark_partition_id()).distinct().count() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_many_speakers_are_read_from_one_stream(spark, capsys):
    lines = [(s, k, f"{s}.{k % 2}.wav\tline {k}") for s in range(30) for k in range(4)]
    files = [(s, f"{s}.{k}.1.wav") for s in range(30) for k in range(3)]
    out = attach.attach_transcript(spark.createDataFrame(files, "speaker long, file string"), spark.createDataFrame(lines, "speaker long, line int, value string"))
    out.explain()
    plan = capsys.readouterr().out
    assert "MapInArrow" in plan and "InPandas" not in plan and "FlatMap" not in plan
    assert sorted(map(tuple, out.collect())) == sorted((s, f"{s}.{k}.1.wav", f"{s}.{k}.wav\tline {k}" if k < 2 else "") for s in range(30) for k in range(3))


def test_first_lines_wherever_batches_end():
    rows = []
    for of, block, chunk in ((1, 0, 0), (1, 0, 1), (2, 0, 0), (3, 0, 0), (4, 0, 0)):
        rows += [(of, block, chunk, name, None, None) for name in ("", "a.wav", "b.wav", "wav") if of != 3]
        rows += [(of, block, chunk, None, n, value) for n, value in ((1, "x"), (2, "ba.wav"), (3, "a.wav b.wav")) if of != 2]
    fields = [("of", pa.int64()), ("block", pa.int64()), ("chunk", pa.int64()), ("name", pa.string()), ("line", pa.int32()), ("value", pa.string())]
    batch = pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, (_, kind) in enumerate(fields)], names=[n for n, _ in fields])
    found = [(1, "", 1, "x"), (1, "a.wav", 2, "ba.wav"), (1, "b.wav", 3, "a.wav b.wav"), (1, "wav", 2, "ba.wav")]
    want = sorted(found * 2 + [(4, *f[1:]) for f in found])
    for size in (1, 2, 3, 5, len(rows)):
        parts = [batch.slice(i, size) for i in range(0, len(rows), size)] + [batch.slice(0, 0)]
        assert sorted(tuple(r.values()) for out in attach.first_lines(iter(parts)) for r in out.to_pylist()) == want


def test_two_systems_or_ten_are_compared_from_one_reading(spark):
    rows = [("a", "1"), ("a", "1"), ("a", None), ("b", "1"), ("b", None), ("b", "2"), ("c", "3"), (None, "4")]
    read = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    frame = spark.createDataFrame(rows, "method string, stem string").mapInArrow(seen, "method string, stem string")
    got = attach.set_differences(frame, "method", "stem")
    assert {tuple(r) for r in got.collect()} == {("a", "b", 1, False), ("a", "c", 3, False), ("b", "c", 4, False)}
    assert read.value == len(rows)
    read.value = 0
    sides = attach.symmetric_difference(frame.where("method = 'a'"), frame.where("method = 'b'"), "stem")
    assert {tuple(r) for r in sides.collect()} == {("2", "right")} and read.value == 2 * len(rows)
    same = spark.createDataFrame([("a", "1"), ("b", "1")], "method string, stem string")
    assert [tuple(r) for r in attach.set_differences(same, "method", "stem").collect()] == [("a", "b", 0, True)]
    assert attach.set_differences(same.where("method = 'a'"), "method", "stem").collect() == []


PAIR = [
    ("1", "s1", "none", "train"), ("1.1", "s1", "A", "train"), ("2", "s1", "none", "val"), ("2.1", "s2", "R", "train"), ("3.1", "s3", "A", "matched"), ("3.1", "s3", "A", "unseen"), ("3", "s3", "none", "matched"),
    ("4.1", "s1", "R", "unseen"), ("5", None, "none", "train"), ("5.1", None, "A", "matched"), ("6.1", "s6", "A", "matched"),
]


def counted(frame, read):
    def seen(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    return frame.mapInArrow(seen, frame.schema)


def test_pair_checks_read_rows_once(spark):
    read = spark.sparkContext.accumulator(0)
    rows = counted(spark.createDataFrame(PAIR, "id string, speaker string, method string, part string"), read)
    got = {tuple(r) for r in integrity.loso_pair_checks(rows, "R").collect()}
    assert read.value == len(PAIR)
    assert got == {
        ("speakers of train in val", 1), ("speakers of train in matched", 1), ("speakers of train in unseen", 1), ("speakers of val in matched", 0), ("speakers of val in unseen", 1), ("spoof in both tests", 1),
        ("genuine clip in one test only", 1), ("held-out system outside its test", 1), ("other system in the unseen test", 1), ("part without both classes", 2), ("spoofs of one test more than of the other", 1),
    }
    assert {r["check"] for r in integrity.loso_pair_checks(rows.limit(0), "R").collect() if r["violations"]} == {"part without both classes"}


def test_a_pair_makes_its_frames_once(spark):
    spoofs = [(f"{k}.{j}", f"s{k}", m, str(k), "train" if k < 3 else "test") for k in range(9) for j, m in enumerate("AAR") if (k, j) != (8, 0)]
    genuine = [(str(k), f"s{k}", "none", str(k), "train" if k < 3 else "test") for k in range(9)]
    columns, read = "id string, speaker string, method string, stem string, split string", spark.sparkContext.accumulator(0)
    out = integrity.loso_pair(counted(spark.createDataFrame(spoofs, columns), read), counted(spark.createDataFrame(genuine, columns), read), "R", "A", "pair")
    of = {tuple(r) for r in out.groupBy("part", "method").count().collect()}
    assert {(p, m): n for p, m, n in of if m != "none"} == {("train", "A"): 6, ("matched", "A"): 6, ("unseen", "R"): 6} and ("train", "none", 3) in of and ("matched", "none", 6) in of
    assert read.value == len(spoofs) + len(genuine)
