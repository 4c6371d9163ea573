import hashlib

import numpy as np
import pytest

from corvane.operators import det, integrity, resample, splits


def _numpy_eer(rows):
    rows = sorted(rows, key=lambda r: (r[1], r[0]))
    bona = np.array([r[2] for r in rows])
    frr, far = np.cumsum(bona) / bona.sum(), 1 - np.cumsum(~bona) / (~bona).sum()
    k = int(np.argmin(np.abs(frr - far)))
    return (frr[k] + far[k]) / 2, rows[k][1]


@pytest.mark.parametrize("ties", [False, True])
def test_eer_and_auc_match_numpy(spark, ties):
    rng = np.random.default_rng(3)
    score = rng.normal(size=600) if not ties else rng.integers(0, 9, 600).astype(float)
    rows = [(int(k), float(s), bool(b)) for k, (s, b) in enumerate(zip(score, rng.random(600) < 0.4))]
    frame = spark.createDataFrame(rows, "id long, score double, bona boolean")
    got = det.eer(frame, []).first()
    want = _numpy_eer(rows)
    assert got["eer"] == pytest.approx(want[0]) and got["threshold"] == want[1]
    ordered = sorted(rows, key=lambda r: (r[1], r[0]))
    nb, ns = sum(r[2] for r in rows), sum(not r[2] for r in rows)
    auc = (sum(k + 1 for k, r in enumerate(ordered) if r[2]) - nb * (nb + 1) / 2) / (nb * ns)
    assert det.auc_ranksum(frame, []).first()["auc"] == pytest.approx(auc)


def test_one_class_has_no_rate(spark):
    frame = spark.createDataFrame([(1, 0.5, True), (2, 0.7, True)], "id long, score double, bona boolean")
    row = det.eer(frame, []).first()
    assert row["eer"] is None and row["n_spoof"] == 0


def test_threshold_row_is_accepted_by_confusion(spark):
    frame = spark.createDataFrame([(1, 0.5, True), (2, 0.4, True), (3, 0.5, False)], "id long, score double, bona boolean")
    from pyspark.sql import functions as F

    row = det.confusion(frame, [], F.lit(0.5)).first()
    assert (row["tp"], row["fp"], row["tn"], row["fn"]) == (1, 1, 0, 1)
    assert det.rates(spark.createDataFrame([(0, 0, 0, 0)], "tp long, fp long, tn long, fn long")).first()["acc"] == 0.0


def test_split_counts_of_140_speakers(spark):
    rows = [(k, "F" if k < 81 else "M") for k in range(140)]
    out = splits.split_members(spark.createDataFrame(rows, "member long, gender string"), "gender", "member")
    got = {(r["split"], r["gender"]): r["count"] for r in out.groupBy("split", "gender").count().collect()}
    assert got == {("train", "F"): 57, ("val", "F"): 12, ("test", "F"): 12, ("train", "M"): 41, ("val", "M"): 9, ("test", "M"): 9}


def test_pairing_guard_is_strict(spark):
    bona = spark.createDataFrame([(str(k), 1) for k in range(95)], "id string, speaker long")
    spoof = spark.createDataFrame([(f"{k}.1", 1, "a", str(k)) for k in range(100)], "id string, speaker long, method string, stem string")
    row = integrity.pairing_rate(bona, spoof).first()
    assert row["twins"] == 95 and row["fatal"] is False


def test_derangement_is_a_bijection(spark):
    frame = spark.createDataFrame([(k, "a" if k % 3 else "b") for k in range(31)] + [(99, "c")], "m long, g string")
    rows = splits.derangement(frame, "g", "m", "s").collect()
    assert all(r["source"] != r["target"] for r in rows) and len({r["target"] for r in rows}) == len(rows) == 31


def test_quotas_give_leftovers_to_the_widest_bin():
    assert splits.quotas({"a": 5, "b": 100, "c": 50}, {"a": 0.25, "b": 0.5, "c": 0.25}, 100) == {"a": 5, "b": 70, "c": 25}


def test_paired_difference_keeps_null_replicates_in_the_share(spark):
    rows = [(0, "x", 0.4), (0, "y", 0.1), (1, "x", None), (1, "y", 0.2)]
    row = resample.paired_difference(spark.createDataFrame(rows, "b long, model string, eer double"), "x", "y").first()
    assert row["n_boot"] == 2 and row["share_positive"] == 0.5


def test_registered_bootstraps_draw_a_thousand_replicates(spark):
    from corvane.plans import detector

    assert detector.N_BOOT == 1000
    rng = np.random.default_rng(6)
    rows = [(k, float(s), k % 3 == 0) for k, s in enumerate(rng.normal(size=30))]
    got = resample.interval(resample.class_bootstrap(spark.createDataFrame(rows, "id long, score double, bona boolean"), detector.N_BOOT), []).first()
    groups, rates = {b: [r for r in rows if r[2] is b] for b in (True, False)}, []
    for b in range(detector.N_BOOT):
        drawn = []
        for bona, own in groups.items():
            for slot in range(len(own)):
                pick = own[int(hashlib.md5(f"boot-{str(bona).lower()}-{b}-{slot}".encode()).hexdigest()[:8], 16) % len(own)]
                drawn.append((f"{pick[0]}-{slot}", pick[1], bona))
        rates.append(_numpy_eer(drawn)[0])
    assert got["n_boot"] == 1000
    assert (got["low"], got["high"]) == pytest.approx(tuple(np.percentile(rates, [2.5, 97.5])))


def _drawn(seed, stratum, b, members):
    return [(members[int(hashlib.md5(f"{seed}-{stratum}-{b}-{slot}".encode()).hexdigest()[:8], 16) % len(members)], slot) for slot in range(len(members))]


def _rate(drawn):
    """The rate of (id, score, bona) in order of score, nulls first and NaN last, then of the id's text; None with one class."""
    if len({r[2] for r in drawn}) < 2:
        return None
    rank = lambda x: (0, 0.0) if x is None else (2, 0.0) if x != x else (1, x)
    return _numpy_eer([(i, rank(x), b) for i, x, b in drawn])[0]


SMALL = {"SLOTS": 7, "BLOCK_PAIRS": 9, "TOGETHER": 3, "SLICE_ROWS": 4}


@pytest.mark.parametrize("sizes", [{}, SMALL])
def test_class_bootstrap_is_that_of_every_draw(spark, monkeypatch, sizes):
    for name, n in sizes.items():
        monkeypatch.setattr(resample, name, n)
    rows = [(k, None if k == 7 else float(k * 7 % 11), k % 3 == 0) for k in range(60)] + [(100 + k, 3.0, False) for k in range(30)]
    got = {r["b"]: r["eer"] for r in resample.class_bootstrap(spark.createDataFrame(rows, "id long, score double, bona boolean"), 12).collect()}
    by = {c: [r for r in rows if r[2] is c] for c in (True, False)}
    want = {b: _rate([(f"{r[0]}-{slot}", *r[1:]) for c, own in by.items() for r, slot in _drawn("boot", str(c).lower(), b, own)]) for b in range(12)}
    assert got == pytest.approx(want)
    one = spark.createDataFrame([r for r in rows if r[2]], "id long, score double, bona boolean")
    assert [r["eer"] for r in resample.class_bootstrap(one, 3).collect()] == [None] * 3
    assert resample.class_bootstrap(one.limit(0), 3).count() == 0


@pytest.mark.parametrize("ascending", [True, False])
@pytest.mark.parametrize("kind", ["long", "string"])
def test_a_score_that_most_rows_share_is_swept_in_runs_of_ids(spark, ascending, kind):
    rng = np.random.default_rng(8)
    score = np.where(rng.random(900) < 0.8, 1.0, rng.normal(size=900))
    rows = [(k if kind == "long" else f"i{k:04d}", float(s), bool(b)) for k, (s, b) in enumerate(zip(score, rng.random(900) < 0.4))]
    frame = spark.createDataFrame(rows, f"id {kind}, score double, bona boolean")
    assert det._sliced(frame, ascending, 32).where("score = 1").select("__slice").distinct().count() > 20
    got = {r["id"]: (r["cb"], r["cs"]) for r in det.swept(frame, [], ascending=ascending).collect()}
    cb = cs = 0
    for i, _, b in sorted(rows, key=lambda r: (r[1] if ascending else -r[1], r[0])):
        cb, cs = cb + b, cs + (not b)
        assert got[i] == (cb, cs)


def test_places_in_a_draw_are_those_of_one_sort(spark):
    rows = [(k, "a" if k < 700 else None) for k in range(800)]
    got = splits.ranked(spark.createDataFrame(rows, "id long, g string"), ["g"], "s", "id").collect()
    for g, n in (("a", 700), (None, 100)):
        ids = sorted((k for k, h in rows if h == g), key=lambda k: hashlib.md5(f"s-{k}".encode()).hexdigest())
        assert [r["id"] for r in sorted((r for r in got if r["g"] == g), key=lambda r: r["__rn"])] == ids
        assert {r["__n"] for r in got if r["g"] == g} == {n}


@pytest.mark.parametrize("kind", ["long", "string"])
def test_numbers_are_places_in_one_sort(spark, kind):
    keys = [k if kind == "long" else f"m{k:04d}" for k in range(600)]
    frame = spark.createDataFrame([(k, "a" if i < 500 else None) for i, k in enumerate(keys)], f"m {kind}, g string").repartition(5)
    got = {r["m"]: r["k"] for r in resample.numbered(frame, ["g"], "m").collect()}
    assert got == {k: i % 500 for i, k in enumerate(keys)}
    assert resample.numbered(frame.limit(0), ["g"], "m").count() == 0


def test_running_lengths_and_shares_are_those_of_one_sort(spark):
    rows = [(k, "a" if k < 500 else "b", k % 13 if k % 9 else None) for k in range(520)]
    frame = spark.createDataFrame(rows, "id long, g string, n int")
    place = lambda k: hashlib.md5(f"s-{k}".encode()).hexdigest()
    want = {}
    for g in "ab":
        ahead = 0
        for k, _, n in sorted((r for r in rows if r[1] == g), key=lambda r: place(r[0])):
            want[k], ahead = ahead, ahead + (n or 0)
    assert {r["id"]: r["__ahead"] for r in splits.ranked(frame, ["g"], "s", "id", "n").collect()} == want
    order = {g: sorted((r[0] for r in rows if r[1] == g), key=place) for g in "ab"}
    first = {k for g, n in (("a", 50), ("b", 2)) for k in order[g][:n]}
    every = sorted((r[0] for r in rows), key=lambda k: (k not in first, place(k)))
    for target in (10, 52, 300, 1000):
        assert {r["id"] for r in splits.per_group_share(frame, "g", "id", 0.1, target, "s").collect()} == set(every[:target])


@pytest.mark.parametrize("sizes", [{}, SMALL])
def test_cluster_bootstrap_is_that_of_every_draw(spark, monkeypatch, sizes):
    for name, n in sizes.items():
        monkeypatch.setattr(resample, name, n)
    # c0 has a third of all rows
    rows = [(k, k % 3 == 0, "c0" if k % 5 == 1 else f"c{k % 7}" if k % 11 else None, float(k * 7 % 23), None if k == 5 else float("nan") if k == 8 else float(k * 5 % 4)) for k in range(90)]
    frame = spark.createDataFrame(rows, "id long, bona boolean, c string, `m 1` double, m2 double")
    got = {(r["b"], r["model"]): r["eer"] for r in resample.cluster_bootstrap(frame, "c", ["m 1", "m2"], 12).collect()}
    clusters, want = sorted({r[2] for r in rows}, key=lambda c: (c is not None, c)), {}
    for b in range(12):
        drawn = [(f"{r[0]}-{slot}", r) for c, slot in _drawn("cluster", "1", b, clusters) if c is not None for r in rows if r[2] == c]
        for place, model in ((3, "m 1"), (4, "m2")):
            want[b, model] = _rate([(i, r[place], r[1]) for i, r in drawn])
    assert got == pytest.approx(want)
    assert {r["eer"] for r in resample.cluster_bootstrap(frame.where("bona"), "c", ["m2"], 3).collect()} == {None}
    assert resample.cluster_bootstrap(frame.limit(0), "c", ["m2"], 3).count() == 0
