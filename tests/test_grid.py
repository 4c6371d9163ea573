"""A grid of conditions that is cut off in the middle goes on, and equals a whole one."""

import numpy as np
import pytest

from corvane.operators import grid


def _rows(spark, seed, n=300, shift=1.0):
    rng = np.random.default_rng(seed)
    rows = [(k, float(rng.normal() + shift * (k % 3 == 0)), k % 3 == 0, None if k % 3 == 0 else "ab"[k % 2]) for k in range(n)]
    return spark.createDataFrame(rows, "id long, score double, bona boolean, system string")


def _result(frame):
    return sorted(map(repr, map(tuple, frame.collect())))


def test_a_run_that_was_cut_goes_on(spark, tmp_path):
    loaded, broken = [], {"opus"}

    def condition(name, seed):
        def load():
            loaded.append(name)
            if name in broken:
                raise OSError("cut off")
            return _rows(spark, seed)

        return load

    conditions = {name: condition(name, seed) for seed, name in enumerate(("clean", "opus", "amr"))}
    calibration = lambda: _rows(spark, 9)
    folder = f"file://{tmp_path}/run"
    with pytest.raises(OSError):
        grid.run(spark, folder, conditions, calibration)
    broken.clear()
    # results of a condition without a commit, as a run leaves them that is cut between the two
    half = grid.judge(_rows(spark, 50), "system", None).selectExpr("*", "'amr' AS condition")
    half.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("condition").parquet(f"{folder}/results")
    judged = []
    judge = grid.judge
    try:
        grid.judge = lambda rows, system, threshold: (judged.append(rows.count()), judge(rows, system, threshold))[1]
        got = _result(grid.run(spark, folder, conditions, calibration))
        assert len(judged) == 2  # clean was committed
        whole = _result(grid.run(spark, f"file://{tmp_path}/whole", conditions, calibration))
        assert got == whole and len(got) == 6
        judged.clear()
        assert _result(grid.run(spark, folder, conditions, calibration)) == whole and not judged
        # another input makes its condition new, another calibration all of them
        conditions["amr"] = condition("amr", 77)
        assert _result(grid.run(spark, folder, conditions, calibration)) != whole and len(judged) == 1
        grid.run(spark, folder, conditions, lambda: _rows(spark, 10))
        assert len(judged) == 4
    finally:
        grid.judge = judge


def test_without_calibration_thresholds_are_labelled(spark, tmp_path):
    got = grid.run(spark, f"file://{tmp_path}/oracle", {"clean": lambda: _rows(spark, 1)}).collect()
    assert {r["source"] for r in got} == {"ORACLE"} and all(r["threshold"] == r["own_threshold"] for r in got)
    assert grid.run(spark, f"file://{tmp_path}/none", {"clean": lambda: _rows(spark, 1).limit(0)}).count() == 0
    with pytest.raises(ValueError, match="both classes"):
        grid.run(spark, f"file://{tmp_path}/one", {}, lambda: _rows(spark, 1).where("bona"))


def test_fingerprints_do_not_depend_on_order(spark):
    rows = _rows(spark, 3)
    assert grid.fingerprint(rows) == grid.fingerprint(rows.orderBy("score").repartition(5)) != grid.fingerprint(rows.where("id <> 4"))
