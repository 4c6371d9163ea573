"""Percentiles by refined counts and products of blocks, against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.operators import probe, selection, vectors

POINTS = {"least": 0.0, "low": 0.1, "middle": 0.5, "high": 0.975, "most": 1.0}


def test_percentiles_of_groups(spark):
    rng = np.random.default_rng(0)
    kinds = [lambda: rng.normal(), lambda: rng.normal() * 1e300, lambda: 0.0, lambda: -0.0, lambda: -1e-310, lambda: 3.0]
    rows = [(g, float(kinds[rng.integers(6)]())) for g, n in (("a", 1), ("b", 2), (None, 7), ("hot", 3000), ("d", 33)) for _ in range(n)]
    frame = spark.createDataFrame([*rows, ("none", None), ("a", None), ("inf", float("inf")), ("inf", float("inf")), ("inf", 1.0), ("nan", float("nan")), ("nan", 1.0)], "g string, v double").repartition(5)
    got = {r["g"]: r for r in selection.percentiles(frame, ["g"], "v", POINTS).collect()}
    for g in ("a", "b", None, "hot", "d"):
        own = [v for h, v in rows if h == g]
        assert [got[g][p] for p in POINTS] == pytest.approx(np.quantile(own, list(POINTS.values())), rel=1e-12)
    assert "none" not in got and got["inf"]["middle"] == float("inf") and got["inf"]["least"] == 1.0 and np.isnan(got["nan"]["most"])


def test_percentiles_of_whole_numbers_and_of_nothing(spark):
    frame = spark.createDataFrame([(k % 7,) for k in range(100)] + [(None,)], "v int")
    assert selection.percentiles(frame, [], "v", {"m": 0.5, "q": 0.25}).first()["m"] == np.median([k % 7 for k in range(100)])
    assert [tuple(r) for r in selection.percentiles(frame.limit(0), [], "v", {"m": 0.5}).collect()] == [(None,)]
    assert selection.percentiles(frame.limit(0).withColumn("g", F.lit(1)), ["g"], "v", {"m": 0.5}).count() == 0
    assert tuple(selection.medians(frame.select("v", (F.col("v") * 2).alias("w"), F.lit(None).cast("double").alias("x")), ["v", "w", "x"]).first()) == (3.0, 6.0, None)


@pytest.mark.parametrize("tile", [4, 2048])
def test_ranks_in_a_gallery_of_many_blocks(spark, tile):
    rng = np.random.default_rng(1)
    gallery = [(f"m{k:02d}", v) for k, v in enumerate(rng.integers(-2, 3, (40, 3)).astype(float).tolist())]
    probes = [(k % 90, f"m{k % 45:02d}", v) for k, v in enumerate(rng.integers(-2, 3, (100, 3)).astype(float).tolist())]
    got = vectors.own_ranks(spark.createDataFrame(probes, "probe long, own string, vector array<double>"), spark.createDataFrame(gallery, "label string, vector array<double>"), tile=tile)
    names, want = dict(gallery), []
    for p, own, v in probes:
        if own in names:
            sim = {m: float(np.dot(v, w)) for m, w in gallery}
            want.append((p, own, 1 + sum(s > sim[own] or s == sim[own] and m < own for m, s in sim.items())))
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)


@pytest.mark.parametrize("tile", [5, 1024])
def test_medians_of_pairs_of_any_number(spark, tile):
    rng = np.random.default_rng(2)
    rows = [(g, f"k{k % 25}" if k else None, rng.normal(size=4).tolist()) for g, n in (("a", 60), (None, 9), ("one", 2)) for k in range(n)]
    got = {r["g"]: (r["pairs"], r["median"]) for r in vectors.median_pairwise(spark.createDataFrame(rows, "g string, k string, v array<double>"), "g", "k", "v", tile=tile).collect()}
    for g in ("a", None):
        own = [(k, np.array(v)) for h, k, v in rows if h == g and k is not None]
        cosines = [float(x @ y) for i, (a, x) in enumerate(own) for b, y in own[i + 1 :] if a != b]
        assert got[g][0] == len(cosines) and got[g][1] == pytest.approx(np.median(cosines), abs=1e-11)
    assert "one" not in got


def test_more_vectors_than_were_allowed_once(spark):
    n = 10_500
    rows = spark.range(n).select(F.lit("g").alias("g"), "id", F.array((F.col("id") % 101).cast("double"), F.lit(1.0)).alias("v"))
    got = vectors.median_pairwise(rows, "g", "id", "v").first()
    x = np.sort(np.add.outer(np.arange(101) ** 1, np.zeros(1)).ravel())
    counts = np.bincount(np.arange(n) % 101)
    value, weight = np.multiply.outer(x, x).ravel() + 1, np.outer(counts, counts) - np.diag(counts)
    order = np.argsort(value)
    upto = np.cumsum(weight.ravel()[order])
    assert got["pairs"] == n * (n - 1) // 2
    assert got["median"] == value[order][np.searchsorted(upto, upto[-1] // 2, side="right")]
    probes = rows.where("id % 500 = 3").select(F.col("id").alias("probe"), F.col("id").alias("own"), "v").withColumnRenamed("v", "vector")
    ranks = {r["probe"]: r["rank"] for r in vectors.own_ranks(probes, rows.select(F.col("id").alias("label"), F.col("v").alias("vector"))).collect()}
    for i in (3, 503, 10_003):
        sims = (np.arange(n) % 101) * (i % 101) + 1
        assert ranks[i] == 1 + (sims > sims[i]).sum() + (sims[:i] == sims[i]).sum()


def test_mean_vectors(spark):
    rows = [("a", [1.0, 2.0]), ("a", [3.0]), ("b", None), ("b", []), (None, [5.0, 7.0])]
    got = {r["g"]: r["mean"] for r in vectors.mean_vector(spark.createDataFrame(rows, "g string, v array<double>"), ["g"], "v").collect()}
    assert got == {"a": [2.0, 2.0], None: [5.0, 7.0]}


def test_probe_is_the_logistic_regression_of_its_definition(spark):
    rng = np.random.default_rng(3)
    n = 300
    x = rng.normal(size=(n, 2)) * [3.0, 0.5] + [10.0, -1.0]
    y = (x[:, 0] - 10 + 4 * (x[:, 1] + 1) + rng.normal(size=n) > 0).astype(int)
    missing = rng.random((n, 2)) < 0.1
    rows = [(k, *[None if m else float(v) for v, m in zip(x[k], missing[k])], int(y[k])) for k in range(n)]
    frame = spark.createDataFrame(rows, "id int, a double, b double, y int")
    got = {r["id"]: r["probability"] for r in probe.fit_probe(frame.where("id < 200"), frame.where("id >= 200"), ["a", "b"], "y").collect()}
    # the same by Newton's method: medians, deviations of the sample, penalty 1/2 |w|^2, none on the intercept
    held = np.where(missing, np.nan, x)
    middle = np.nanmedian(held[:200], axis=0)
    z = np.where(missing, middle, x)
    z = (z - z[:200].mean(0)) / z[:200].std(0, ddof=1)
    z = np.column_stack([z, np.ones(n)])
    w, ridge = np.zeros(3), np.diag([1.0, 1.0, 0.0])
    for _ in range(30):
        p = 1 / (1 + np.exp(-z[:200] @ w))
        w -= np.linalg.solve(z[:200].T * (p * (1 - p)) @ z[:200] + ridge, z[:200].T @ (p - y[:200]) + ridge @ w)
    want = 1 / (1 + np.exp(-z[200:] @ w))
    assert [got[k] for k in range(200, n)] == pytest.approx(want.tolist(), abs=1e-4)
