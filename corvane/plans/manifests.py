"""Splits, pairing and integrity queries.

Members are customers in market segments. The genuine clip of an order has its number as stem; a spoof is a
line of it, `stem.line`, made by the system in `l_returnflag`. Orders of status P have no genuine clip.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import integrity, splits
from .catalogue import query


def members(spark, sf_dir) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("member"), F.col("c_mktsegment").alias("stratum"), F.col("c_nationkey").alias("nation"))


def split_members(spark, sf_dir) -> DataFrame:
    return splits.split_members(members(spark, sf_dir), "stratum", "member")


_M = "m AS (SELECT c_custkey AS member, c_mktsegment AS stratum, c_nationkey AS nation FROM customer)"


def _ranked(src: str, strata: str, seed: str, key: str) -> str:
    return f"(SELECT *, row_number() OVER (PARTITION BY {strata} ORDER BY md5('{seed}-' || {key}), {key}) AS rn, count(*) OVER (PARTITION BY {strata}) AS n FROM {src})"


_S = f"""{_M}, mr AS {_ranked('m', 'stratum', '42', 'member')},
  mt AS (SELECT *, CASE WHEN n >= 3 THEN least(round_even(n * 0.7::DOUBLE, 0)::BIGINT, n - 2) ELSE round_even(n * 0.7::DOUBLE, 0)::BIGINT END AS nt, round_even(n * 0.15::DOUBLE, 0)::BIGINT AS nv0 FROM mr),
  mv AS (SELECT *, CASE WHEN n >= 3 THEN greatest(1, least(nv0, n - nt - 1)) ELSE nv0 END AS nv FROM mt),
  s AS (SELECT member, stratum, nation, CASE WHEN rn <= nt THEN 'train' WHEN rn <= nt + nv THEN 'val' ELSE 'test' END AS split FROM mv)"""


@query("split_speakers", f"WITH {_S} SELECT member, stratum, nation, split FROM s")
def split_speakers(spark, sf_dir):
    return split_members(spark, sf_dir)


@query("split_summary", f"WITH {_S} SELECT split, stratum, count(*) AS members FROM s GROUP BY GROUPING SETS ((split), (split, stratum))")
def split_summary(spark, sf_dir):
    sets = split_members(spark, sf_dir).groupingSets([["split"], ["split", "stratum"]], "split", "stratum")
    return sets.agg(F.count("*").alias("members"))


@query("split_disjointness", f"WITH {_S} SELECT a.split AS split_a, b.split AS split_b, count(*) AS shared FROM s a JOIN s b ON a.nation = b.nation AND a.split < b.split GROUP BY ALL UNION ALL SELECT 'members', 'members', 0 FROM (SELECT 1) WHERE NOT EXISTS (SELECT 1 FROM s a JOIN s b ON a.member = b.member AND a.split < b.split)")
def split_disjointness(spark, sf_dir):
    """Pairs of splits that share a nation (they do), and one row that says that they share no member."""
    rows = split_members(spark, sf_dir)
    by_nation = integrity.overlaps(rows, "nation", "split")
    clean = integrity.overlaps(rows, "member", "split").agg(F.coalesce(F.sum("shared"), F.lit(0)).alias("shared")).where("shared = 0")
    return by_nation.union(clean.select(F.lit("members"), F.lit("members"), "shared"))


_SEL = f"{_M}, r AS {_ranked('m', 'stratum', 'pick', 'member')}, x AS (SELECT *, rn <= round_even(n * 0.5::DOUBLE, 0) AS selected FROM r)"


@query("stratified_select", f"WITH {_SEL} SELECT member, stratum, nation, selected FROM x")
def stratified_select(spark, sf_dir):
    return splits.stratified(members(spark, sf_dir), "stratum", "member", 0.5, "pick")


@query(
    "selection_drift",
    f"""WITH {_SEL}, g AS (SELECT stratum, count(*) AS members, count(*) FILTER (selected) AS chosen FROM x GROUP BY stratum)
    SELECT stratum, members, chosen, round(100.0::DOUBLE * members / sum(members) OVER (), 6) AS share_all, round(100.0::DOUBLE * chosen / sum(chosen) OVER (), 6) AS share_chosen,
    abs(100.0::DOUBLE * members / sum(members) OVER () - 100.0::DOUBLE * chosen / sum(chosen) OVER ()) > 5 AS drifts FROM g""",
)
def selection_drift(spark, sf_dir):
    return integrity.drift(stratified_select(spark, sf_dir), "stratum", "selected", points=5)


def clips(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """(genuine, spoof) clips."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    bona = orders.where("o_orderstatus <> 'P'").select(F.col("o_orderkey").cast("string").alias("id"), F.col("o_custkey").alias("speaker"))
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_returnflag")
    ids = lines.groupBy("l_orderkey", "l_linenumber").agg(F.min("l_returnflag").alias("method"))
    owner = orders.select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("speaker"))
    spoof = ids.join(owner, "l_orderkey").select(F.concat_ws(".", F.col("l_orderkey"), F.col("l_linenumber")).alias("id"), "speaker", "method")
    return bona, spoof.withColumn("stem", integrity.stem("id"))


_C = r"""bona AS (SELECT o_orderkey::VARCHAR AS id, o_custkey AS speaker FROM orders WHERE o_orderstatus <> 'P'),
  li AS (SELECT l_orderkey, l_linenumber, min(l_returnflag) AS method FROM lineitem GROUP BY 1, 2),
  spoof AS (SELECT l_orderkey || '.' || l_linenumber AS id, o_custkey AS speaker, method, regexp_replace(l_orderkey || '.' || l_linenumber, '\.\d$', '') AS stem FROM li JOIN orders ON o_orderkey = l_orderkey),
  kept AS (SELECT * FROM spoof s WHERE EXISTS (SELECT 1 FROM bona b WHERE b.id = s.stem AND b.speaker = s.speaker)),
  lost AS (SELECT * FROM spoof s WHERE NOT EXISTS (SELECT 1 FROM bona b WHERE b.id = s.stem AND b.speaker = s.speaker))"""


@query("pairing_kept", f"WITH {_C} SELECT id, speaker, method, stem FROM kept")
def pairing_kept(spark, sf_dir):
    return integrity.paired(*clips(spark, sf_dir))


@query("pairing_excluded", f"WITH {_C} SELECT id, speaker, method, stem FROM lost")
def pairing_excluded(spark, sf_dir):
    return integrity.unpaired(*clips(spark, sf_dir))


@query("pairing_rate", f"WITH {_C}, t AS (SELECT method, count(*) AS spoofs, count(*) FILTER (id IN (SELECT id FROM kept)) AS twins FROM spoof GROUP BY method) SELECT method, spoofs, twins, round(100.0::DOUBLE * twins / spoofs, 6) AS rate, CASE WHEN 100.0 * twins / spoofs >= 99.9 THEN 'PASS' WHEN 100.0 * twins / spoofs >= 50 THEN 'WARN' ELSE 'FAIL' END AS verdict, (spoofs - twins)::DOUBLE / spoofs > 0.05 AS fatal FROM t")
def pairing_rate(spark, sf_dir):
    return integrity.pairing_rate(*clips(spark, sf_dir))


@query("unpaired_report", f"WITH {_C}, g AS (SELECT method, speaker, count(*) AS lost FROM lost GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY method ORDER BY lost DESC, speaker) AS place, sum(lost) OVER (PARTITION BY method)::BIGINT AS of_method FROM g) SELECT method, speaker, lost, place, of_method FROM r WHERE place <= 5")
def unpaired_report(spark, sf_dir):
    return integrity.top_by_group(integrity.unpaired(*clips(spark, sf_dir)), "method", "speaker", 5)


def split_clips(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Paired spoofs with the split of their speaker, and the genuine pool in the same columns."""
    bona, spoof = clips(spark, sf_dir)
    split = split_members(spark, sf_dir).select(F.col("member").alias("speaker"), "split")
    kept = integrity.paired(bona, spoof).join(split, "speaker").select("id", "speaker", "method", "stem", "split")
    pool = bona.join(split, "speaker").select("id", "speaker", F.lit("none").alias("method"), F.col("id").alias("stem"), "split")
    return kept, pool


_SC = f"""{_S}, {_C}, k AS (SELECT kept.id, kept.speaker, method, stem, split FROM kept JOIN s ON s.member = kept.speaker),
  pool AS (SELECT bona.id, bona.speaker, 'none' AS method, bona.id AS stem, split FROM bona JOIN s ON s.member = bona.speaker),
  ls AS (SELECT * FROM k WHERE (split <> 'test' AND method <> 'R') OR (split = 'test' AND method = 'R')),
  loso AS (SELECT * FROM ls UNION ALL SELECT * FROM pool WHERE stem IN (SELECT stem FROM ls))"""


def _loso(spark, sf_dir) -> DataFrame:
    kept, pool = split_clips(spark, sf_dir)
    return splits.leave_one_out(kept, "R", system="method", split="split", pool=pool)


@query("loso_manifests", f"WITH {_SC} SELECT split, method, count(*) AS clips, count(DISTINCT speaker) AS speakers FROM loso GROUP BY 1, 2")
def loso_manifests(spark, sf_dir):
    return _loso(spark, sf_dir).groupBy("split", "method").agg(F.count("*").alias("clips"), F.countDistinct("speaker").alias("speakers"))


@query(
    "loso_checks",
    f"""WITH {_SC}, a AS (SELECT 'speakers shared by splits' AS check, count(*) AS violations FROM (SELECT speaker FROM loso GROUP BY speaker HAVING count(DISTINCT split) > 1)),
    b AS (SELECT 'held-out system in train or val', count(*) FROM loso WHERE split <> 'test' AND method = 'R'), c AS (SELECT 'other system in test', count(*) FROM loso WHERE split = 'test' AND method NOT IN ('R', 'none')),
    d AS (SELECT 'split without both classes', count(*) FROM (SELECT split FROM loso GROUP BY split HAVING count(*) FILTER (method = 'none') = 0 OR count(*) FILTER (method <> 'none') = 0)),
    e AS (SELECT 'spoof without twin', count(*) FROM loso x WHERE method <> 'none' AND NOT EXISTS (SELECT 1 FROM loso y WHERE y.method = 'none' AND y.stem = x.stem)),
    f AS (SELECT 'clip listed twice', count(*) FROM (SELECT id FROM loso GROUP BY id HAVING count(*) > 1))
    SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c UNION ALL SELECT * FROM d UNION ALL SELECT * FROM e UNION ALL SELECT * FROM f""",
)
def loso_checks(spark, sf_dir):
    return integrity.loso_checks(_loso(spark, sf_dir), "R")


_TP = f"""{_SC}, sides AS (SELECT * FROM k WHERE method IN ('A', 'R')), sr AS {_ranked('sides', 'method', 'trim', 'id')},
  trimmed AS (SELECT * FROM sr WHERE rn <= (SELECT min(n) FROM sr)), shared AS (SELECT DISTINCT id FROM pool WHERE stem IN (SELECT stem FROM trimmed))"""


@query("test_pair_shared_pool", f"WITH {_TP} SELECT method, count(*) AS spoofs, (SELECT count(*) FROM shared) AS bonafide FROM trimmed GROUP BY method")
def test_pair_shared_pool(spark, sf_dir):
    """Two systems trimmed to the smaller, judged against one pool of the twins of both."""
    kept, pool = split_clips(spark, sf_dir)
    trimmed, shared = integrity.test_pair(kept, pool, ["A", "R"], "trim")
    return trimmed.groupBy("method").agg(F.count("*").alias("spoofs")).crossJoin(F.broadcast(shared.agg(F.count("*").alias("bonafide"))))


@query("split_by_source", f"WITH {_SC}, t AS (SELECT DISTINCT method FROM k), u AS (SELECT method, id FROM k WHERE split = 'test' UNION ALL SELECT t.method, pool.id FROM t, pool WHERE split = 'test') SELECT method AS system, count(*) AS clips FROM u GROUP BY method")
def split_by_source(spark, sf_dir):
    kept, pool = split_clips(spark, sf_dir)
    test = kept.where("split = 'test'").select("method", "id")
    every = pool.where("split = 'test'").select("id").crossJoin(F.broadcast(kept.select("method").distinct())).select("method", "id")
    return test.union(every).groupBy(F.col("method").alias("system")).agg(F.count("*").alias("clips"))


_L = "l AS (SELECT doc_id, quality FROM labels)"


@query("subsample_balanced", f"WITH {_L}, r AS {_ranked('l', 'quality', 'sub', 'doc_id')} SELECT doc_id, quality FROM r WHERE rn <= 50 OR (SELECT count(*) FROM l) <= 100")
def subsample_balanced(spark, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    return splits.balanced(labels, "quality", "doc_id", 100, "sub")


@query("balance_bonafide", f"WITH {_C}, r AS {_ranked('bona', 'speaker', 'bal', 'id')} SELECT id, speaker FROM r ORDER BY CASE WHEN rn <= greatest(1, round_even(n * 0.5::DOUBLE, 0)) THEN 0 ELSE 1 END, md5('bal-' || id), id LIMIT 2000")
def balance_bonafide(spark, sf_dir):
    return splits.per_group_share(clips(spark, sf_dir)[0], "speaker", "id", 0.5, 2000, "bal")


@query(
    "quota_sample",
    f"""WITH d AS (SELECT doc_id, n_chars, CASE WHEN n_chars < 600 THEN 'short' WHEN n_chars <= 3000 THEN 'medium' ELSE 'long' END AS bin FROM documents), r AS {_ranked('d', 'bin', 'quota', 'doc_id')}
    SELECT doc_id, n_chars, bin FROM r WHERE rn <= CASE bin WHEN 'medium' THEN 50 ELSE 25 END""",
)
def quota_sample(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "n_chars")
    bins = F.when(F.col("n_chars") < 600, "short").when(F.col("n_chars") <= 3000, "medium").otherwise("long")
    return splits.quota_sample(docs.withColumn("bin", bins), "bin", "doc_id", {"short": 0.25, "medium": 0.5, "long": 0.25}, 100, "quota")


@query(
    "greedy_cover",
    f"""WITH d AS (SELECT doc_id, source, n_chars FROM documents), r AS {_ranked('d', 'source', 'cover', 'doc_id')},
    a AS (SELECT *, coalesce(sum(n_chars) OVER (PARTITION BY source ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead FROM r),
    body AS (SELECT doc_id, source, n_chars, rn AS place FROM a WHERE rn < 5 AND (ahead < 12000 OR rn <= 1)),
    short AS (SELECT source, sum(n_chars) AS got FROM a WHERE rn <= 4 GROUP BY source HAVING sum(n_chars) < 12000 AND count(*) = 4),
    t AS (SELECT a.*, 12000 - got AS gap FROM a JOIN short USING (source) WHERE rn >= 5),
    l AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY CASE WHEN n_chars >= gap THEN 0 ELSE 1 END, CASE WHEN n_chars >= gap THEN n_chars ELSE -n_chars END, rn) AS c FROM t)
    SELECT doc_id, source, n_chars, place FROM body UNION ALL SELECT doc_id, source, n_chars, 5 FROM l WHERE c = 1""",
)
def greedy_cover(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "n_chars")
    return splits.greedy_cover(docs, "source", "doc_id", "n_chars", target=12000).withColumn("place", F.col("place").cast("long"))


_D = f"{_S}, dr AS {_ranked('s', 'split', 'pair', 'member')}, pairs AS (SELECT split, member AS source, coalesce(lead(member) OVER (PARTITION BY split ORDER BY rn), first(member) OVER (PARTITION BY split ORDER BY rn)) AS target, n FROM dr QUALIFY n >= 2)"


def _pairs(spark, sf_dir) -> DataFrame:
    return splits.derangement(split_members(spark, sf_dir), "split", "member", "pair")


@query("derangement", f"WITH {_D} SELECT split, source, target FROM pairs")
def derangement(spark, sf_dir):
    return _pairs(spark, sf_dir)


@query("pair_checks", f"""WITH {_D} SELECT 'fixed point' AS check, count(*) AS violations FROM pairs WHERE source = target UNION ALL SELECT 'repeated target', count(*) FROM (SELECT target FROM pairs GROUP BY target HAVING count(*) > 1)
  UNION ALL SELECT 'repeated source', count(*) FROM (SELECT source FROM pairs GROUP BY source HAVING count(*) > 1) UNION ALL SELECT 'target of another split', count(*) FROM pairs p JOIN s ON s.member = p.target WHERE s.split <> p.split
  UNION ALL SELECT 'member without pair', count(*) FROM s WHERE member NOT IN (SELECT source FROM pairs) UNION ALL SELECT 'unknown target', count(*) FROM pairs WHERE target NOT IN (SELECT member FROM s)""")
def pair_checks(spark, sf_dir):
    return integrity.pair_checks(_pairs(spark, sf_dir), split_members(spark, sf_dir))


@query("drift_check", f"WITH {_S} SELECT member, CASE member % 10 WHEN 0 THEN 'train' WHEN 1 THEN 'val' ELSE split END AS recorded, split AS current FROM s WHERE CASE member % 10 WHEN 0 THEN 'train' WHEN 1 THEN 'val' ELSE split END <> split")
def drift_check(spark, sf_dir):
    """Members whose recorded split is not the current one."""
    now = split_members(spark, sf_dir)
    recorded = now.select("member", F.when(F.col("member") % 10 == 0, "train").when(F.col("member") % 10 == 1, "val").otherwise(F.col("split")).alias("split"))
    return integrity.drifted(recorded, now, "member", "split")


@query("batch_page", "SELECT c_custkey AS member FROM customer ORDER BY 1 LIMIT 30 OFFSET 60")
def batch_page(spark, sf_dir):
    return splits.page(members(spark, sf_dir).select("member"), "member", 3)


@query("corpus_balance", f"WITH {_SC}, disk AS (SELECT method, count(*) AS on_disk FROM spoof GROUP BY 1), ex AS (SELECT method, count(*) AS excluded FROM lost GROUP BY 1), ma AS (SELECT method, count(*) AS listed FROM k GROUP BY 1) SELECT method, coalesce(on_disk, 0) AS on_disk, coalesce(excluded, 0) AS excluded, coalesce(listed, 0) AS listed, coalesce(on_disk, 0) - coalesce(excluded, 0) = coalesce(listed, 0) AS balanced FROM disk FULL JOIN ex USING (method) FULL JOIN ma USING (method)")
def corpus_balance(spark, sf_dir):
    """What is on disk less what is unpaired, against the manifests of all splits."""
    bona, spoof = clips(spark, sf_dir)
    return integrity.balance(spoof, integrity.unpaired(bona, spoof), split_clips(spark, sf_dir)[0], "method")


_LP = f"""{_SC}, fs AS (SELECT * FROM k WHERE split <> 'test' AND method <> 'R'), sd AS (SELECT * FROM k WHERE split = 'test' AND method IN ('A', 'R')), sq AS {_ranked('sd', 'method', 'pair', 'id')},
  tr AS (SELECT id, speaker, method, stem FROM sq WHERE rn <= (SELECT min(n) FROM sq)), gp AS (SELECT DISTINCT id, speaker, method, stem FROM pool WHERE split = 'test' AND stem IN (SELECT stem FROM tr)),
  lp AS (SELECT id, speaker, method, split AS part FROM fs UNION ALL SELECT id, speaker, method, split FROM pool WHERE stem IN (SELECT stem FROM fs) UNION ALL
    SELECT id, speaker, method, CASE method WHEN 'R' THEN 'unseen' ELSE 'matched' END FROM tr UNION ALL SELECT id, speaker, method, p FROM gp, (VALUES ('matched'), ('unseen')) v(p))"""


def _loso_pair(spark, sf_dir) -> DataFrame:
    kept, pool = split_clips(spark, sf_dir)
    return integrity.loso_pair(kept, pool, "R", "A", "pair")


@query("loso_pair", f"WITH {_LP} SELECT part, method, count(*) AS clips, count(DISTINCT speaker) AS speakers FROM lp GROUP BY 1, 2")
def loso_pair(spark, sf_dir):
    return _loso_pair(spark, sf_dir).groupBy("part", "method").agg(F.count("*").alias("clips"), F.countDistinct("speaker").alias("speakers"))


def _met(a: str, b: str) -> str:
    return f"SELECT 'speakers of {a} in {b}' AS check, count(*) AS violations FROM (SELECT speaker FROM lp WHERE part = '{a}' INTERSECT SELECT speaker FROM lp WHERE part = '{b}')"


@query(
    "loso_pair_checks",
    f"""WITH {_LP} {" UNION ALL ".join(_met(a, b) for a, b in (("train", "val"), ("train", "matched"), ("train", "unseen"), ("val", "matched"), ("val", "unseen")))}
    UNION ALL SELECT 'spoof in both tests', count(*) FROM (SELECT id FROM lp WHERE method <> 'none' AND part = 'matched' INTERSECT SELECT id FROM lp WHERE method <> 'none' AND part = 'unseen')
    UNION ALL SELECT 'genuine clip in one test only', count(*) FROM (SELECT id FROM lp WHERE method = 'none' AND part IN ('matched', 'unseen') GROUP BY id HAVING count(DISTINCT part) = 1)
    UNION ALL SELECT 'held-out system outside its test', count(*) FROM lp WHERE method = 'R' AND part <> 'unseen' UNION ALL SELECT 'other system in the unseen test', count(*) FROM lp WHERE part = 'unseen' AND method NOT IN ('R', 'none')
    UNION ALL SELECT 'part without both classes', count(*) FROM (VALUES ('train'), ('val'), ('matched'), ('unseen')) v(p) WHERE NOT EXISTS (SELECT 1 FROM lp WHERE part = p AND method = 'none') OR NOT EXISTS (SELECT 1 FROM lp WHERE part = p AND method <> 'none')
    UNION ALL SELECT 'spoofs of one test more than of the other', abs(count(*) FILTER (part = 'matched' AND method <> 'none') - count(*) FILTER (part = 'unseen' AND method <> 'none')) FROM lp""",
)
def loso_pair_checks(spark, sf_dir):
    return integrity.loso_pair_checks(_loso_pair(spark, sf_dir), "R")


@query("reference_build", f"WITH d AS (SELECT doc_id, source, n_chars FROM documents WHERE lang = 'en'), r AS {_ranked('d', 'source', 'vcref', 'doc_id')}, a AS (SELECT *, coalesce(sum(n_chars) OVER (PARTITION BY source ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead FROM r) SELECT doc_id, source, n_chars, rn AS place FROM a WHERE ahead < 20000")
def reference_build(spark, sf_dir):
    """English documents of each source until they come to 20,000 characters; the language stands for the sample rate."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "n_chars", "lang")
    return splits.reference(docs, "source", "doc_id", "n_chars", target=20000, usable=F.col("lang") == "en", seed="vcref").drop("lang")


@query("dry_run_sample", f"WITH d AS (SELECT doc_id, source FROM documents), r AS {_ranked('d', 'source', 'dry', 'doc_id')} SELECT doc_id, source FROM r WHERE rn <= 400")
def dry_run_sample(spark, sf_dir):
    return splits.at_most(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source"), "source", "doc_id", 400, "dry")


@query("paired_pool", f"WITH {_C} SELECT stem, count(*) AS spoofs FROM spoof WHERE stem NOT IN (SELECT id FROM bona) GROUP BY stem")
def paired_pool(spark, sf_dir):
    """Stems of spoofs that no genuine clip has."""
    return integrity.paired_pool(*clips(spark, sf_dir))[1]


_PF = f"""{_S}, {_C}, al AS (SELECT id, speaker, method, stem FROM spoof UNION ALL SELECT id, speaker, 'none', id FROM bona), r AS (SELECT al.*, split FROM al JOIN s ON s.member = al.speaker),
  pr AS (SELECT split, count(*) AS n, count(*) FILTER (EXISTS (SELECT 1 FROM r b WHERE b.method = 'none' AND b.split = r.split AND b.id = r.stem)) AS t FROM r WHERE method <> 'none' GROUP BY split),
  sp AS (SELECT speaker, bool_or(split = 'train') AS a, bool_or(split = 'val') AS b, bool_or(split = 'test') AS c FROM r GROUP BY speaker),
  z AS (SELECT 'speakers of train in val' AS "check", count(*) FILTER (a AND b) AS n FROM sp UNION ALL SELECT 'speakers of train in test', count(*) FILTER (a AND c) FROM sp UNION ALL SELECT 'speakers of val in test', count(*) FILTER (b AND c) FROM sp
    UNION ALL SELECT 'A mixed with N', least(count(*) FILTER (method = 'A'), count(*) FILTER (method = 'N')) FROM r)"""


@query("preflight", f"""WITH {_PF} SELECT 'pairing in ' || split AS "check", CASE WHEN 100.0 * t / n >= 99.9 THEN 'PASS' WHEN 100.0 * t / n >= 50 THEN 'WARN' ELSE 'FAIL' END AS status, n - t AS n FROM pr
  UNION ALL SELECT "check", CASE WHEN n = 0 THEN 'PASS' ELSE 'FAIL' END, n FROM z""")
def preflight(spark, sf_dir):
    """All spoofs and genuine clips by their speaker's split; systems A and N stand for two corpora, which are mixed here."""
    bona, spoof = clips(spark, sf_dir)
    split = split_members(spark, sf_dir).select(F.col("member").alias("speaker"), "split")
    rows = spoof.select("id", "speaker", "method", "stem").unionByName(bona.select("id", "speaker", F.lit("none").alias("method"), F.col("id").alias("stem")))
    return integrity.preflight(rows.join(split, "speaker"), ("A", "N"))
