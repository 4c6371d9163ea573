from corvane.operators import det, reports


def test_reversed_scores_are_reported(spark):
    rows = [(1, 0.1, True, "none"), (2, 0.2, True, "none"), (3, 0.9, False, "a"), (4, 0.0, False, "b")]
    got = {r["system"]: r for r in reports.by_system(spark.createDataFrame(rows, "id long, score double, bona boolean, system string")).collect()}
    assert set(got) == {"pooled", "a", "b"}
    assert got["pooled"]["inverted"] and got["a"]["inverted"] and not got["b"]["inverted"]
    assert got["pooled"]["n_spoof"] == 2 and got["a"]["n_bona"] == 2


def test_own_threshold_is_an_oracle_and_never_a_mismatch(spark):
    rows = [(k, float(k), k % 2 == 0 or k > 10, "t") for k in range(20)]
    frame = spark.createDataFrame(rows, "id long, score double, bona boolean, t string")
    own = reports.calibrated(frame, "t").first()
    assert own["source"] == "ORACLE" and not own["mismatch"] and own["threshold"] == det.eer(frame, []).first()["threshold"]
    other = reports.calibrated(frame, "t", spark.createDataFrame([(3.5,)], "threshold double")).first()
    assert other["source"] == "calibrated" and other["mismatch"] and other["tp"] + other["fn"] == own["tp"] + own["fn"]


def test_each_identity_check_can_fail(spark):
    clips = "written boolean, frames long, ratio double, corr double"
    ranks = spark.createDataFrame([(1.0, 9.0)], "target_rank double, source_rank double")
    run = lambda rows, r=ranks, **more: {x["check"]: x["passed"] for x in reports.identity_checks(spark.createDataFrame(rows, clips), r, 20, 0.95, **more).collect()}
    assert all(run([(True, 5, 1.0, 0.1)]).values())
    bad = run([(False, None, 3.0, 0.99), (True, 0, 3.0, 0.99)], spark.createDataFrame([(9.0, 2.0)], "target_rank double, source_rank double"))
    assert not any(bad.values()) and len(bad) == 6
    assert run([(False, None, 1.0, 0.1)], partial=True)["every expected clip written"]
    assert not any(v for k, v in run([(True, 5, 1.0, 0.1)], ranks.limit(0)).items() if k.startswith("target"))


def test_split_report_counts_facets_within_their_split(spark):
    rows = [("train", "x", None), ("train", "y", "m"), ("train", "y", "f"), ("test", "z", "m")]
    got = {(r["split"], r["facet"], r["value"]): (r["clips"], r["members"], r["percent"]) for r in reports.split_report(spark.createDataFrame(rows, "split string, speaker string, gender string"), ["gender"]).collect()}
    assert got[("train", "all", None)] == (3, 2, 100.0)
    assert got[("train", "gender", None)] == (1, 1, 33.333333) and got[("test", "gender", "m")] == (1, 1, 100.0)


def test_levels_that_agree_after_are_ok(spark):
    rows = [("a", -30.0, -20.0), ("a", -32.0, -20.2), ("b", -10.0, -20.1)]
    got = reports.level_change(spark.createDataFrame(rows, "source string, x double, y double"), "source", "x", "y").collect()
    assert all(r["ok"] for r in got) and {r["source"]: r["mean_in"] for r in got} == {"a": -31.0, "b": -10.0}


def test_inventory_counts_known_traits_only(spark):
    rows = [("s", 2, "", 16), ("s", 3, "f", 8), ("t", 1, None, 16)]
    got = {(r["measure"], r["value"]): r["n"] for r in reports.inventory(spark.createDataFrame(rows, "speaker string, sec long, gender string, rate long"), "speaker", "sec", ["gender"], ["rate"]).collect()}
    assert got == {("clips", ""): 3, ("members", ""): 2, ("length", ""): 6, ("rate", ""): 2, ("gender", "f"): 1}
