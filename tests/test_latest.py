"""The stream of keys and values against the batch reader, over restarts and late files."""

from corvane.sources import tables
from corvane.streaming import latest


def test_last_line_wins_over_restarts(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    done = spark.createDataFrame([("k9",), ("k1",)], "key string")
    waves = [
        {"b.txt": "k1 - one\nno sign\nk2 - two\n\nk1 - later\n - empty\nk3 - \n"},
        {"c.txt": "k2 - newer - still\r\nk4 - four\nk9 - x\n", "d.txt": "k4 - last"},
        {"a.txt": "k2 - from an earlier file\nk5 - five\n"},  # comes late, sorts first
        {},
    ]
    for files in waves:
        for name, text in files.items():
            (folder / name).write_bytes(text.encode())
        args = (spark, f"file://{folder}", f"file://{tmp_path}/all", f"file://{tmp_path}/all-progress")
        got = {r["key"]: r["value"] for r in latest.run_once(*args, files_per_batch=1).collect()}
        want, wanted = {}, sorted(p for p in folder.iterdir())
        for path in wanted:
            for line in path.read_bytes().decode().splitlines():
                key, sign, value = (x.strip() for x in line.partition(" - "))
                if sign and key and value:
                    want[key] = value
        assert got == want
    batch = {r["key"]: r["value"] for r in tables.key_values(spark, f"file://{folder}").collect()}
    assert set(batch) == set(want)
    left = latest.run_once(spark, f"file://{folder}", f"file://{tmp_path}/left", f"file://{tmp_path}/left-progress", done)
    assert {r["key"]: r["value"] for r in left.collect()} == {k: v for k, v in want.items() if k not in ("k9", "k1")}


def test_an_empty_folder_gives_no_keys(spark, tmp_path):
    (tmp_path / "in").mkdir()
    assert latest.run_once(spark, f"file://{tmp_path}/in", f"file://{tmp_path}/t", f"file://{tmp_path}/p").count() == 0
