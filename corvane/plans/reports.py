"""Report queries over the stand-ins of the other plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import attach, det, reports
from .catalogue import query
from .detector import _E, _POOL, _eer, _rounded, _sweep, scored
from .manifests import _SC, split_clips

_ALL = f"{_E}, {_POOL}, a AS (SELECT id, score, bona, g FROM p UNION ALL SELECT id, score, bona, 'pooled' FROM e)"


@query(
    "system_report",
    f"""WITH {_ALL}, {_eer('a', 'g', 'r')}, m AS (SELECT g, sum(score) FILTER (bona) / count(*) FILTER (bona) AS mb, sum(score) FILTER (NOT bona) / count(*) FILTER (NOT bona) AS ms FROM a GROUP BY g)
    SELECT g AS system, n_bona, n_spoof, round(eer, 9) AS eer, round(mb, 6) AS mean_bona, round(ms, 6) AS mean_spoof, NOT coalesce(mb > ms, false) AS inverted FROM r JOIN m USING (g)""",
)
def system_report(spark, sf_dir):
    """The pooled rate, each system's against the shared pool, and whether scores seem to be the wrong way round."""
    out = reports.by_system(scored(spark, sf_dir).select("id", "score", "bona", "system"))
    return _rounded(out, "eer").withColumns({c: F.round(c, 6) for c in ("mean_bona", "mean_spoof")})


def _report_sql(threshold: str, source: str, name: str) -> str:
    return f"""{name} AS (SELECT p.g AS system, '{source}' AS source, max(o.eer) AS eer, max(o.threshold) AS own, max({threshold}) AS threshold,
      count(*) FILTER (score >= {threshold} AND bona) AS tp, count(*) FILTER (score >= {threshold} AND NOT bona) AS fp,
      count(*) FILTER (score < {threshold} AND NOT bona) AS tn, count(*) FILTER (score < {threshold} AND bona) AS fn FROM p JOIN o USING (g), c GROUP BY p.g)"""


@query(
    "calibrated_report",
    f"""WITH {_E}, {_POOL}, {_eer('p', 'g', 'o')}, v AS (SELECT *, 1 AS g FROM e WHERE system IN ('view', 'error')), {_eer('v', 'g', 'cc')}, c AS (SELECT threshold AS t FROM cc),
    {_report_sql('c.t', 'calibrated', 'k1')}, {_report_sql('o.threshold', 'ORACLE', 'k2')}, k AS (SELECT * FROM k1 UNION ALL SELECT * FROM k2)
    SELECT system, source, round(eer, 9) AS eer, threshold, own AS own_threshold, abs(threshold - own) > 1e-9 AS mismatch, tp, fp, tn, fn, round((tp + tn)::DOUBLE / (tp + tn + fp + fn), 9) AS acc FROM k""",
)
def calibrated_report(spark, sf_dir):
    """Every system at the threshold of system `error`, and at its own."""
    rows = scored(spark, sf_dir)
    pool = rows.select("id", "score", "bona", "system")
    given = det.eer(rows.where("system in ('view', 'error')"), []).select("threshold")
    both = reports.calibrated(pool, "system", given).unionByName(reports.calibrated(pool, "system"))
    return _rounded(both.select("system", "source", "eer", "threshold", "own_threshold", "mismatch", "tp", "fp", "tn", "fn", "acc"), "eer", "acc")


@query(
    "probe_by_source",
    f"""WITH {_E}, {_POOL}, {_sweep('p', 'g', 'd', desc=True)}, f AS (SELECT *, 1 - cb::DOUBLE / nb AS fnr, cs::DOUBLE / ns AS fpr FROM d),
    r AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY abs(fnr - fpr), rn) AS pick FROM f), {_eer('p', 'g', 'o')},
    x AS (SELECT r.g AS system, (r.fnr + r.fpr) / 2 AS eer, o.eer AS model FROM r JOIN o USING (g) WHERE pick = 1)
    SELECT system, round(eer, 9) AS eer, CASE WHEN eer >= 0.40 THEN 'CLEAN' WHEN eer >= 0.25 THEN 'MILD' WHEN eer >= 0.10 THEN 'SERIOUS' ELSE 'CRITICAL' END AS verdict,
    CASE WHEN model >= eer THEN 'no better' WHEN eer - model < 0.05 THEN 'barely better' ELSE 'clearly better' END AS detector FROM x""",
)
def probe_by_source(spark, sf_dir):
    """The descending sweep by system, its verdict, and the ascending sweep's rate held against it as the detector's."""
    rows = scored(spark, sf_dir).select("id", "score", "bona", "system")
    model = det.system_eer(rows, "system").select("system", F.col("eer").alias("model"))
    out = det.system_eer(rows, "system", ascending=False).join(model, "system")
    return out.select("system", F.round("eer", 9).alias("eer"), det.verdict(F.col("eer")).alias("verdict"), reports.against_model(F.col("eer"), F.col("model")).alias("detector"))


_RANKS = "k AS (SELECT event_id, user_id % 50 + 1 AS target_rank, user_id % 70 + 1 AS source_rank, event_type <> 'error' AS written, user_id % 9 AS frames, value / 50 AS ratio, value / 100 AS corr FROM events)"


@query(
    "identity_checks",
    f"""WITH {_RANKS}, s AS (SELECT count(*) FILTER (NOT written) AS missing, count(*) FILTER (written AND frames <= 0) AS empty, median(ratio) AS ratio, median(corr) AS corr, median(target_rank) AS t, median(source_rank) AS o FROM k)
    SELECT 'every expected clip written' AS check, missing = 0 AS passed FROM s UNION ALL SELECT 'no empty clips', empty = 0 FROM s UNION ALL SELECT 'duration kept', ratio BETWEEN 0.8 AND 1.25 FROM s
    UNION ALL SELECT 'not a pass-through', corr < 0.95 FROM s UNION ALL SELECT 'target ranks better than chance', t < 35.5 * 0.75 FROM s UNION ALL SELECT 'target ranks above source', t < o FROM s""",
)
def identity_checks(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    u = F.col("user_id")
    clips = e.select((F.col("event_type") != "error").alias("written"), (u % 9).alias("frames"), (F.col("value") / 50).alias("ratio"), (F.col("value") / 100).alias("corr"))
    return reports.identity_checks(clips, e.select((u % 50 + 1).alias("target_rank"), (u % 70 + 1).alias("source_rank")), gallery=70, noop=0.95)


@query(
    "split_report",
    f"""WITH {_SC}, u AS (SELECT *, 'spoof' AS label FROM k UNION ALL SELECT *, 'bonafide' FROM pool),
    g AS (SELECT split, 'all' AS facet, NULL AS value, count(*) AS clips, count(DISTINCT speaker) AS members FROM u GROUP BY split
      UNION ALL SELECT split, 'label', label, count(*), count(DISTINCT speaker) FROM u GROUP BY ALL UNION ALL SELECT split, 'method', method, count(*), count(DISTINCT speaker) FROM u GROUP BY ALL)
    SELECT split, facet, value, clips, members, round(100.0::DOUBLE * clips / (sum(clips) FILTER (facet = 'all') OVER (PARTITION BY split)), 6) AS percent FROM g""",
)
def split_report(spark, sf_dir):
    """Clips and speakers of each split, by label and by method."""
    spoof, pool = split_clips(spark, sf_dir)
    rows = spoof.withColumn("label", F.lit("spoof")).unionByName(pool.withColumn("label", F.lit("bonafide")))
    return reports.split_report(rows, ["label", "method"])


@query(
    "level_change",
    """WITH g AS (SELECT event_type AS source, count(*) AS n, avg(value) AS mi, stddev_pop(value) AS si, avg(value / 100) AS mo, stddev_pop(value / 100) AS so FROM events GROUP BY 1)
    SELECT source, n, round(mi, 6) AS mean_in, round(si, 6) AS std_in, round(mo, 6) AS mean_out, round(so, 6) AS std_out, round((SELECT stddev_pop(mo) FROM g), 6) AS spread, (SELECT stddev_pop(mo) FROM g) < 0.5 AS ok FROM g""",
)
def level_change(spark, sf_dir):
    """Levels by source before and after a gain of a hundredth."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_type").alias("source"), "value", (F.col("value") / 100).alias("after"))
    out = reports.level_change(e, "source", "value", "after")
    return out.withColumns({c: F.round(c, 6) for c in ("mean_in", "std_in", "mean_out", "std_out", "spread")})


@query(
    "inventory_summary",
    """WITH r AS (SELECT o_custkey AS speaker, o_orderdate AS day, o_orderstatus AS kind, c_mktsegment AS gender FROM orders JOIN customer ON c_custkey = o_custkey)
    SELECT 'clips' AS measure, '' AS value, count(*) AS n FROM r UNION ALL SELECT 'members', '', count(DISTINCT speaker) FROM r UNION ALL SELECT 'length', '', sum(length(kind))::BIGINT FROM r
    UNION ALL SELECT 'kind', '', count(DISTINCT kind) FROM r UNION ALL SELECT 'gender', gender, count(DISTINCT speaker) FROM r GROUP BY gender""",
)
def inventory_summary(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_custkey").alias("speaker"), F.col("o_orderstatus").alias("kind"))
    owners = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("speaker"), F.col("c_mktsegment").alias("gender"))
    rows = orders.join(owners, "speaker").withColumn("length", F.char_length("kind"))
    return reports.inventory(rows, "speaker", "length", ["gender"], ["kind"])


@query("spoof_systems", "SELECT event_type AS system FROM events WHERE event_type <> 'view' GROUP BY 1")
def spoof_systems(spark, sf_dir):
    """The distinct systems of a manifest; the list is short by its nature."""
    rows = scored(spark, sf_dir).select(F.when(F.col("bona"), "none").otherwise(F.col("system")).alias("method"))
    return attach.systems(rows).withColumnRenamed("method", "system")


@query(
    "describe_splits",
    f"""WITH {_SC} SELECT split, count(*) AS clips, count(*) FILTER (method = 'none') AS bonafide, count(*) FILTER (method <> 'none') AS spoof, count(DISTINCT speaker) AS speakers,
    coalesce(string_agg(DISTINCT method, ',' ORDER BY method) FILTER (method <> 'none'), '-') AS systems FROM loso GROUP BY split""",
)
def describe_splits(spark, sf_dir):
    """The splits of a leave-one-out manifest, with the systems of each."""
    from .manifests import _loso

    return reports.describe_splits(_loso(spark, sf_dir))
