"""One sweep for all systems against the sweep of each system with its own copy of the genuine rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.operators import det, reports


def _expected(rows, ascending):
    """(pool, system) -> (n_bona, n_spoof, eer, threshold, auc) by a full sort of each system's rows."""
    out = {}
    for p, g in {(r[0], r[1]) for r in rows if not r[4]}:
        own = [r for r in rows if r[0] == p and (r[4] or r[1] == g)]
        own.sort(key=lambda r: (r[3] if ascending else -r[3], r[2]))
        bona = np.array([r[4] for r in own])
        nb, ns = int(bona.sum()), int((~bona).sum())
        cb, cs = np.cumsum(bona), np.cumsum(~bona)
        if not nb:
            out[p, g] = (nb, ns, None, None, None)
            continue
        one, two = (cb / nb, 1 - cs / ns) if ascending else (1 - cb / nb, cs / ns)
        k = int(np.argmin(np.abs(one - two)))
        wins = sum(nb - c if ascending else c for c in cb[~bona])
        out[p, g] = (nb, ns, (one[k] + two[k]) / 2, own[k][3], wins / (nb * ns))
    return out


def _frame(spark, rows):
    return spark.createDataFrame(rows, "p string, system string, id long, score double, bona boolean").repartition(4)


@pytest.mark.parametrize("ascending", [True, False])
@pytest.mark.parametrize("seed", range(4))
def test_every_system_against_shared_genuine_rows(spark, ascending, seed):
    rng = np.random.default_rng(seed)
    rows = []
    for k in range(400):
        # few distinct scores in some seeds, one score in a third of the rows, a system of one row, a pool without genuine rows
        score = float(rng.normal()) if seed % 2 else 1.0 if k % 3 == 0 else float(rng.integers(0, 6))
        p = [None, "x", "bare"][int(rng.integers(3))]
        bona = bool(rng.random() < 0.4) and p != "bare"
        rows.append((p, None if bona else ["a", "b", None, "hot", "hot", "hot"][int(rng.integers(6))], k, score + (0.5 if bona else 0.0), bona))
    rows.append(("x", "single", 900, 2.0, False))
    got = {(r["p"], r["system"]): r for r in det.system_eer(_frame(spark, rows), "system", ["p"], ascending=ascending).collect()}
    want = _expected(rows, ascending)
    assert set(got) == set(want)
    for key, (nb, ns, eer, threshold, auc) in want.items():
        r = got[key]
        assert (r["n_bona"], r["n_spoof"]) == (nb, ns)
        assert (r["eer"], r["threshold"], r["auc"]) == ((None, None, None) if eer is None else (pytest.approx(eer, abs=1e-12), threshold, pytest.approx(auc)))


def test_small_cases_of_every_order(spark):
    rng = np.random.default_rng(9)
    rows = []
    for case in range(150):
        for k in range(int(rng.integers(1, 8))):
            bona = bool(rng.random() < 0.5)
            rows.append((f"c{case}", None if bona else "s", case * 10 + k, float(rng.integers(0, 4)), bona))
    for ascending in (True, False):
        got = {r["p"]: r for r in det.system_eer(_frame(spark, rows), "system", ["p"], ascending=ascending).collect()}
        for (p, _), (_, _, eer, threshold, _) in _expected(rows, ascending).items():
            assert (got[p]["eer"], got[p]["threshold"]) == ((None, None) if eer is None else (pytest.approx(eer, abs=1e-12), threshold))


def test_confusion_counts_genuine_rows_once(spark):
    rng = np.random.default_rng(4)
    rows = [("x", None if k % 3 == 0 else "abc"[k % 2], k, float(rng.integers(0, 9)), k % 3 == 0) for k in range(200)]
    limits = {"a": 4.0, "b": 7.0}
    frame = _frame(spark, rows)
    got = {r["system"]: r for r in det.system_confusion(frame, "system", spark.createDataFrame(list(limits.items()), "system string, threshold double")).collect()}
    for g, t in limits.items():
        own = [r for r in rows if r[4] or r[1] == g]
        cells = [sum(1 for r in own if (r[3] >= t) is above and r[4] is bona) for above, bona in ((True, True), (True, False), (False, False), (False, True))]
        assert [got[g][c] for c in ("tp", "fp", "tn", "fn")] == cells
    assert {r["source"] for r in reports.calibrated(frame.drop("p"), "system").collect()} == {"ORACLE"}


def test_genuine_rows_are_not_copied(spark):
    frame = _frame(spark, [("x", None, 1, 0.5, True), ("x", "a", 2, 0.4, False)])
    plan = det.pool_sweep(frame, "system", [])._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Cross" not in plan and "Union" not in plan
    assert det.pool_sweep(frame, "system", []).agg(F.count("*")).first()[0] == 2
