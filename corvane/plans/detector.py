"""Detector queries over `events`: value is the score, `view` the genuine class, other types the systems."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import det, resample
from .catalogue import query


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select(F.col("event_id").alias("id"), F.col("value").alias("score"), (F.col("event_type") == "view").alias("bona"), F.col("event_type").alias("system"), "user_id", "props")


_E = "e AS (SELECT event_id AS id, value AS score, event_type = 'view' AS bona, event_type AS system, user_id, props FROM events)"
_POOL = "p AS (SELECT id, score, bona, system AS g FROM e WHERE NOT bona UNION ALL SELECT e.id, e.score, e.bona, s.system FROM e, (SELECT DISTINCT system FROM e WHERE NOT bona) s WHERE e.bona)"


def _sweep(src: str, g: str, out: str = "w", desc: bool = False, tie: str = "id") -> str:
    order = f"score {'DESC' if desc else 'ASC'}, {tie}"
    return f"""{out} AS (SELECT *, row_number() OVER o AS rn, sum(bona::INT) OVER o AS cb, sum((NOT bona)::INT) OVER o AS cs,
      sum(bona::INT) OVER (PARTITION BY {g}) AS nb, sum((NOT bona)::INT) OVER (PARTITION BY {g}) AS ns
      FROM {src} WINDOW o AS (PARTITION BY {g} ORDER BY {order} ROWS UNBOUNDED PRECEDING))"""


def _eer(src: str, g: str, out: str, tie: str = "id") -> str:
    return f"""{_sweep(src, g, out + '_w', tie=tie)},
    {out}_c AS (SELECT *, CASE WHEN nb > 0 THEN cb::DOUBLE / nb END AS frr, CASE WHEN ns > 0 THEN 1 - cs::DOUBLE / ns END AS far FROM {out}_w),
    {out}_r AS (SELECT *, row_number() OVER (PARTITION BY {g} ORDER BY abs(frr - far), rn) AS pick FROM {out}_c),
    {out} AS (SELECT {g}, nb::BIGINT AS n_bona, ns::BIGINT AS n_spoof, CASE WHEN nb > 0 AND ns > 0 THEN (frr + far) / 2 END AS eer,
      CASE WHEN nb > 0 AND ns > 0 THEN score END AS threshold FROM {out}_r WHERE pick = 1)"""


def _rounded(frame: DataFrame, *columns: str) -> DataFrame:
    return frame.withColumns({c: F.round(c, 9) for c in columns})


@query("eer_pooled", f"WITH {_E}, a AS (SELECT *, 1 AS g FROM e), {_eer('a', 'g', 'r')} SELECT n_bona, n_spoof, round(eer, 9) AS eer, threshold FROM r")
def eer_pooled(spark, sf_dir):
    return _rounded(det.eer(scored(spark, sf_dir), []), "eer")


@query("eer_per_source", f"WITH {_E}, {_POOL}, {_eer('p', 'g', 'r')} SELECT g AS system, n_bona, n_spoof, round(eer, 9) AS eer, threshold FROM r")
def eer_per_source(spark, sf_dir):
    return _rounded(det.system_eer(scored(spark, sf_dir), "system").drop("auc"), "eer")


@query(
    "eer_presets",
    f"""WITH {_E}, a AS (SELECT *, 1 AS g FROM e), b AS (SELECT id, bona, score - 50.0::DOUBLE AS score, 1 AS g FROM e),
    {_eer('b', 'g', 'r1')}, {_eer('a', 'g', 'r2')}, {_sweep('a', 'g', 'd', desc=True)},
    dd AS (SELECT *, 1 - cb::DOUBLE / nb AS fnr, cs::DOUBLE / ns AS fpr FROM d)
    SELECT 'difference' AS preset, round(eer, 9) AS eer FROM r1 UNION ALL SELECT 'single', round(eer, 9) FROM r2
    UNION ALL SELECT 'descending', round((fnr + fpr) / 2, 9) FROM (SELECT * FROM dd ORDER BY abs(fnr - fpr), rn LIMIT 1)""",
)
def eer_presets(spark, sf_dir):
    """The three conventions: a difference of class scores, one class score, and the sweep from above."""
    rows = scored(spark, sf_dir)
    one = det.eer(rows.withColumn("score", F.col("score") - 50.0), []).select(F.lit("difference").alias("preset"), "eer")
    two = det.eer(rows, []).select(F.lit("single").alias("preset"), "eer")
    three = det.descending_eer(rows, []).select(F.lit("descending").alias("preset"), "eer")
    return _rounded(one.union(two).union(three), "eer")


@query("det_points", f"WITH {_E}, a AS (SELECT *, 1 AS g FROM e), {_sweep('a', 'g')} SELECT id, score, round(cb::DOUBLE / nb, 9) AS frr, round(1 - cs::DOUBLE / ns, 9) AS far FROM w")
def det_points(spark, sf_dir):
    return _rounded(det.det_curve(scored(spark, sf_dir), []).select("id", "score", "frr", "far"), "frr", "far")


@query(
    "auc_ranksum",
    f"WITH {_E}, {_POOL}, {_sweep('p', 'g')} SELECT g AS system, max(nb)::BIGINT AS n_bona, max(ns)::BIGINT AS n_spoof, round((sum(CASE WHEN bona THEN rn END) - max(nb) * (max(nb) + 1) / 2)::DOUBLE / (max(nb) * max(ns)), 9) AS auc FROM w GROUP BY g",
)
def auc_ranksum(spark, sf_dir):
    return _rounded(det.system_eer(scored(spark, sf_dir), "system").select("system", "n_bona", "n_spoof", "auc"), "auc")


@query(
    "auc_trapezoid",
    f"""WITH {_E}, {_POOL}, {_sweep('p', 'g', desc=True)},
    t AS (SELECT g, rn, cb::DOUBLE / nb AS tpr, cs::DOUBLE / ns AS fpr, lag(cb::DOUBLE / nb) OVER l AS ptpr, lag(cs::DOUBLE / ns) OVER l AS pfpr FROM w WINDOW l AS (PARTITION BY g ORDER BY rn))
    SELECT g AS system, round(sum((fpr - pfpr) * (tpr + ptpr) / 2), 6) AS auc FROM t GROUP BY g""",
)
def auc_trapezoid(spark, sf_dir):
    return det.system_eer(scored(spark, sf_dir), "system", ascending=False).select("system", F.round("auc", 6).alias("auc"))


_CAL = f"""WITH {_E}, v AS (SELECT *, 1 AS g FROM e WHERE system IN ('view', 'error')), {_eer('v', 'g', 'r')},
  q AS (SELECT id, score, bona, system AS g FROM e WHERE NOT bona UNION ALL
    SELECT e.id, e.score, e.bona, s.system FROM e, (SELECT DISTINCT system FROM e WHERE NOT bona) s WHERE e.bona),
  k AS (SELECT q.g AS system, r.threshold, count(*) FILTER (score >= threshold AND bona) AS tp, count(*) FILTER (score >= threshold AND NOT bona) AS fp,
    count(*) FILTER (score < threshold AND NOT bona) AS tn, count(*) FILTER (score < threshold AND bona) AS fn FROM q, r GROUP BY ALL)"""


def _calibrated(spark, sf_dir) -> DataFrame:
    rows = scored(spark, sf_dir)
    threshold = det.eer(rows.where("system in ('view', 'error')"), []).select("threshold")
    systems = rows.where("not bona").select("system").distinct().crossJoin(F.broadcast(threshold))
    return det.system_confusion(rows, "system", systems)


@query("confusion_at_calibrated", f"{_CAL} SELECT system, threshold, tp, fp, tn, fn FROM k")
def confusion_at_calibrated(spark, sf_dir):
    """System `error` calibrates the threshold, every system is judged by it."""
    return _calibrated(spark, sf_dir)


def _div(a: str, b: str) -> str:
    return f"coalesce(round(({a})::DOUBLE / nullif({b}, 0), 9), 0)"


@query(
    "prf_report",
    f"""{_CAL} SELECT system, {_div('tp + tn', 'tp + tn + fp + fn')} AS acc, {_div('tp', 'tp + fp')} AS bona_precision, {_div('tp', 'tp + fn')} AS bona_recall,
    {_div('2 * tp', '2 * tp + fp + fn')} AS bona_f1, {_div('tn', 'tn + fn')} AS spoof_precision, {_div('tn', 'tn + fp')} AS spoof_recall, {_div('2 * tn', '2 * tn + fp + fn')} AS spoof_f1,
    round((coalesce((2 * tp)::DOUBLE / nullif(2 * tp + fp + fn, 0), 0) + coalesce((2 * tn)::DOUBLE / nullif(2 * tn + fp + fn, 0), 0)) / 2, 9) AS macro_f1 FROM k""",
)
def prf_report(spark, sf_dir):
    out = det.rates(_calibrated(spark, sf_dir)).drop("threshold", "tp", "fp", "tn", "fn")
    return _rounded(out, *[c for c in out.columns if c != "system"])


_COND = "CASE id % 3 WHEN 0 THEN 'clean' WHEN 1 THEN 'opus' ELSE 'amr' END"


def _conditions(spark, sf_dir) -> DataFrame:
    rows = scored(spark, sf_dir).withColumn("condition", F.expr(_COND))
    return det.system_eer(rows, "system", ["condition"])


_MATRIX = f"""WITH {_E}, c AS (SELECT *, {_COND} AS condition FROM e),
  s AS (SELECT DISTINCT condition, system FROM c WHERE NOT bona),
  p AS (SELECT id, score, bona, condition || '|' || system AS g FROM c WHERE NOT bona UNION ALL SELECT c.id, c.score, c.bona, s.condition || '|' || s.system FROM c JOIN s USING (condition) WHERE c.bona),
  {_eer('p', 'g', 'r')}, m AS (SELECT split_part(g, '|', 1) AS condition, split_part(g, '|', 2) AS system, eer FROM r)"""


@query("condition_matrix", f"{_MATRIX} SELECT condition, {', '.join(f'''round(max(CASE WHEN system = '{s}' THEN eer END), 9) AS {s}''' for s in ('click', 'error', 'purchase', 'signup'))} FROM m GROUP BY condition")
def condition_matrix(spark, sf_dir):
    systems = ["click", "error", "purchase", "signup"]
    return _rounded(_conditions(spark, sf_dir).groupBy("condition").pivot("system", systems).agg(F.max("eer")), *systems)


@query("loso_gap", f"{_MATRIX} SELECT a.condition, round(a.eer, 9) AS unseen, round(b.eer, 9) AS matched, round(a.eer - b.eer, 9) AS gap FROM m a JOIN m b USING (condition) WHERE a.system = 'error' AND b.system = 'click'")
def loso_gap(spark, sf_dir):
    """Held-out system `error` against matched system `click`."""
    wide = _conditions(spark, sf_dir).groupBy("condition").pivot("system", ["error", "click"]).agg(F.max("eer"))
    return _rounded(wide.select("condition", F.col("error").alias("unseen"), F.col("click").alias("matched"), (F.col("error") - F.col("click")).alias("gap")), "unseen", "matched", "gap")


N_BOOT = 1000
_H = "('0x' || substr(md5({}), 1, 8))::BIGINT"
_PAIR = "z AS (SELECT * FROM e WHERE system IN ('view', 'error'))"


@query(
    "bootstrap_class_ci",
    f"""WITH {_E}, {_PAIR}, n AS (SELECT *, row_number() OVER (PARTITION BY bona ORDER BY id) - 1 AS k, count(*) OVER (PARTITION BY bona) AS n FROM z),
    d AS (SELECT b.b, s.slot, c.bona, {_H.format("'boot-' || c.bona || '-' || b.b || '-' || s.slot")} % c.n AS k FROM (SELECT bona, max(n) AS n FROM n GROUP BY bona) c,
      (SELECT unnest(range({N_BOOT})) AS b) b, LATERAL (SELECT unnest(range(c.n)) AS slot) s),
    x AS (SELECT d.b AS g, n.id || '-' || d.slot AS id, n.score, d.bona FROM d JOIN n USING (bona, k)), {_eer('x', 'g', 'r')}
    SELECT count(*) AS n_boot, round(quantile_cont(eer, 0.025), 9) AS low, round(quantile_cont(eer, 0.975), 9) AS high FROM r""",
)
def bootstrap_class_ci(spark, sf_dir):
    rows = scored(spark, sf_dir).where("system in ('view', 'error')")
    return _rounded(resample.interval(resample.class_bootstrap(rows, N_BOOT), []), "low", "high")


_CLUSTER = f"""WITH {_E}, {_PAIR}, zz AS (SELECT *, score AS m1, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS m2 FROM z),
  u AS (SELECT user_id, row_number() OVER (ORDER BY user_id) - 1 AS k, count(*) OVER () AS n FROM (SELECT DISTINCT user_id FROM zz)),
  d AS (SELECT b.b, s.slot, {_H.format("'cluster-1-' || b.b || '-' || s.slot")} % c.n AS k FROM (SELECT max(n) AS n FROM u) c, (SELECT unnest(range({N_BOOT})) AS b) b, LATERAL (SELECT unnest(range(c.n)) AS slot) s),
  y AS (SELECT d.b, d.slot, zz.* FROM d JOIN u USING (k) JOIN zz USING (user_id)),
  x AS (SELECT b || '|m1' AS g, id || '-' || slot AS id, m1 AS score, bona FROM y UNION ALL SELECT b || '|m2', id || '-' || slot, m2, bona FROM y), {_eer('x', 'g', 'r')},
  q AS (SELECT split_part(g, '|', 1)::BIGINT AS b, split_part(g, '|', 2) AS model, eer FROM r)"""


def _clustered(spark, sf_dir) -> DataFrame:
    rows = scored(spark, sf_dir).where("system in ('view', 'error')")
    rows = rows.select("id", "bona", "user_id", F.col("score").alias("m1"), F.get_json_object("props", "$.k").cast("double").alias("m2"))
    return resample.cluster_bootstrap(rows, "user_id", ["m1", "m2"], N_BOOT)


@query("bootstrap_cluster_ci", f"{_CLUSTER} SELECT model, count(*) AS n_boot, round(quantile_cont(eer, 0.025), 9) AS low, round(quantile_cont(eer, 0.975), 9) AS high FROM q GROUP BY model")
def bootstrap_cluster_ci(spark, sf_dir):
    return _rounded(resample.interval(_clustered(spark, sf_dir), ["model"]), "low", "high")


@query(
    "bootstrap_paired_diff",
    f"""{_CLUSTER}, f AS (SELECT a.eer - c.eer AS d FROM q a JOIN q c USING (b) WHERE a.model = 'm1' AND c.model = 'm2')
    SELECT count(*) AS n_boot, round(quantile_cont(d, 0.025), 9) AS low, round(quantile_cont(d, 0.975), 9) AS high, round(count(*) FILTER (d > 0)::DOUBLE / count(*), 9) AS share_positive,
    coalesce(quantile_cont(d, 0.025) > 0 OR quantile_cont(d, 0.975) < 0, false) AS excludes_zero FROM f""",
)
def bootstrap_paired_diff(spark, sf_dir):
    return _rounded(resample.paired_difference(_clustered(spark, sf_dir), "m1", "m2"), "low", "high", "share_positive")


@query(
    "directional_eer",
    f"""WITH {_E}, {_POOL}, n AS (SELECT id, -score AS score, bona, g FROM p), {_eer('p', 'g', 'r1')}, {_eer('n', 'g', 'r2')}
    SELECT g AS system, round(least(r1.eer, r2.eer), 9) AS eer, CASE WHEN r1.eer <= r2.eer THEN 1 ELSE -1 END AS sign FROM r1 JOIN r2 USING (g) WHERE r1.n_bona + r1.n_spoof >= 10""",
)
def directional_eer(spark, sf_dir):
    """The better of a score and its negative, for groups of ten values or more."""
    rows = scored(spark, sf_dir)
    rows = rows.where(det.finite(F.col("score")))
    up = det.system_eer(rows, "system").where("n_bona + n_spoof >= 10").select("system", F.col("eer").alias("up"))
    down = det.system_eer(rows.withColumn("score", -F.col("score")), "system").select("system", F.col("eer").alias("down"))
    return up.join(down, "system").select("system", F.round(F.least("up", "down"), 9).alias("eer"), F.when(F.col("up") <= F.col("down"), 1).otherwise(-1).alias("sign"))


@query(
    "verdict_band",
    f"WITH {_E}, {_POOL}, {_eer('p', 'g', 'r')} SELECT g AS system, CASE WHEN eer >= 0.40 THEN 'CLEAN' WHEN eer >= 0.25 THEN 'MILD' WHEN eer >= 0.10 THEN 'SERIOUS' ELSE 'CRITICAL' END AS verdict FROM r",
)
def verdict_band(spark, sf_dir):
    return det.system_eer(scored(spark, sf_dir), "system").select("system", det.verdict(F.col("eer")).alias("verdict"))


@query(
    "univariate_rank",
    f"""WITH {_E}, {_PAIR}, f AS (SELECT 'value' AS g, id, score, bona FROM z UNION ALL SELECT 'k', id, CAST(json_extract_string(props, '$.k') AS DOUBLE), bona FROM z UNION ALL SELECT 'hour', id, 0.0::DOUBLE + user_id % 24, bona FROM z),
    n AS (SELECT g, id, -score AS score, bona FROM f), {_eer('f', 'g', 'r1')}, {_eer('n', 'g', 'r2')}
    SELECT g AS feature, round(least(r1.eer, r2.eer), 9) AS eer, least(r1.eer, r2.eer) < 0.30 AS marked, row_number() OVER (ORDER BY least(r1.eer, r2.eer), g) AS place FROM r1 JOIN r2 USING (g)""",
)
def univariate_rank(spark, sf_dir):
    """Every feature by the error rate it gives alone, in its better direction."""
    from pyspark.sql import Window

    rows = scored(spark, sf_dir).where("system in ('view', 'error')")
    features = {"value": F.col("score"), "k": F.get_json_object("props", "$.k").cast("double"), "hour": (F.col("user_id") % 24).cast("double")}
    long = rows.select("id", "bona", F.explode(F.create_map(*[x for n, c in features.items() for x in (F.lit(n), c)])).alias("feature", "score"))
    up = det.eer(long, ["feature"]).select("feature", F.col("eer").alias("up"))
    down = det.eer(long.withColumn("score", -F.col("score")), ["feature"]).select("feature", F.col("eer").alias("down"))
    best = up.join(down, "feature").select("feature", F.least("up", "down").alias("eer"))
    place = F.row_number().over(Window.orderBy("eer", "feature")).cast("long")
    return best.select("feature", F.round("eer", 9).alias("eer"), (F.col("eer") < 0.30).alias("marked"), place.alias("place"))


@query(
    "condition_grid",
    f"""WITH {_E}, v AS (SELECT *, 1 AS g FROM e WHERE id % 5 = 0), {_eer('v', 'g', 'cal')}, c AS (SELECT *, {_COND} AS condition FROM e WHERE id % 5 <> 0),
    s AS (SELECT DISTINCT condition, system FROM c WHERE NOT bona),
    p AS (SELECT id, score, bona, condition || '|' || system AS g FROM c WHERE NOT bona UNION ALL SELECT c.id, c.score, c.bona, s.condition || '|' || s.system FROM c JOIN s USING (condition) WHERE c.bona),
    {_eer('p', 'g', 'own')}, t AS (SELECT p.g, count(*) FILTER (score >= cal.threshold AND bona) AS tp, count(*) FILTER (score >= cal.threshold AND NOT bona) AS fp,
      count(*) FILTER (score < cal.threshold AND NOT bona) AS tn, count(*) FILTER (score < cal.threshold AND bona) AS fn, any_value(cal.threshold) AS threshold FROM p, cal GROUP BY p.g)
    SELECT split_part(g, '|', 1) AS condition, split_part(g, '|', 2) AS system, round(own.eer, 9) AS eer, t.threshold, own.threshold AS own_threshold, tp, fp, tn, fn, round((tp + tn)::DOUBLE / (tp + tn + fp + fn), 9) AS acc
    FROM t JOIN own USING (g)""",
)
def condition_grid(spark, sf_dir):
    """Three conditions, every system of each, at the threshold that a fifth of the rows gives."""
    import uuid

    from ..operators import grid
    from ..session import shared_folder

    rows = scored(spark, sf_dir).withColumn("condition", F.expr(_COND))
    test = rows.where("id % 5 <> 0")
    of = lambda name: lambda: test.where(F.col("condition") == name)
    out = grid.run(spark, f"{shared_folder(spark)}/grid-{uuid.uuid4().hex}", {c: of(c) for c in ("clean", "opus", "amr")}, lambda: rows.where("id % 5 = 0"))
    return _rounded(out.select("condition", "system", "eer", "threshold", "own_threshold", "tp", "fp", "tn", "fn", "acc"), "eer", "acc")
