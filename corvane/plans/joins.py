"""Attaching joins and the plans that follow from them, over the same stand-ins as the manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import attach
from .catalogue import query
from .detector import scored
from .manifests import _C, clips, members


@query("attach_system", "WITH m AS (SELECT event_id AS id, event_type AS method FROM events WHERE event_id % 7 <> 0) SELECT event_id AS id, method, method IS NOT NULL AS matched FROM events LEFT JOIN m ON id = event_id")
def attach_system(spark, sf_dir):
    """Predictions with their system; a seventh of the ids is not in the manifest."""
    rows = scored(spark, sf_dir)
    return attach.attach_system(rows.select("id"), rows.where("id % 7 <> 0").select("id", F.col("system").alias("method"))).select("id", "method", "matched")


@query("attach_speaker", f"WITH {_C}, b AS (SELECT id, speaker FROM bona) SELECT spoof.id, coalesce(x.speaker, y.speaker) AS speaker FROM spoof LEFT JOIN b x ON x.id = spoof.id LEFT JOIN b y ON y.id = spoof.stem WHERE coalesce(x.speaker, y.speaker) IS NOT NULL")
def attach_speaker(spark, sf_dir):
    """Spoofs find their speaker by the genuine clip that is their stem; those without one are left out here."""
    bona, spoof = clips(spark, sf_dir)
    return attach.attach_speaker(spoof.select("id"), bona, fatal=False).where("speaker is not null").select("id", "speaker")


@query("attach_gender", "SELECT o_orderkey AS id, o_custkey AS speaker, lower(c_mktsegment) AS gender FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_custkey % 5 <> 0")
def attach_gender(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("speaker"))
    return attach.attach_gender(orders, _genders(spark, sf_dir))[0].select("id", "speaker", "gender")


def _genders(spark, sf_dir) -> DataFrame:
    return members(spark, sf_dir).select(F.col("member").alias("speaker"), F.when(F.col("member") % 5 == 0, " ").otherwise(F.col("stratum")).alias("gender"))


@query("speakers_without_gender", "SELECT o_custkey AS speaker, count(*) AS clips FROM orders WHERE o_custkey % 5 = 0 GROUP BY 1")
def speakers_without_gender(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("speaker"))
    return attach.attach_gender(orders, _genders(spark, sf_dir))[1]


@query("attach_features", "SELECT p.page_id, d.n_chars FROM pages p LEFT JOIN (SELECT doc_id, n_chars FROM documents WHERE doc_id % 3 = 0) d ON d.doc_id = p.page_id")
def attach_features(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.col("page_id").alias("path"))
    features = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id % 3 = 0").select(F.col("doc_id").alias("path"), "n_chars")
    return attach.attach_features(pages, features).select("page_id", "n_chars")


@query("attach_source", "SELECT d.doc_id, coalesce(CASE WHEN d.doc_id % 4 = 0 THEN d.source END, '<no source in log>') AS source FROM documents d")
def attach_source(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source")
    return attach.attach_source(docs.select("doc_id"), docs.where("doc_id % 4 = 0"), ["doc_id"])


_NAMES = "s AS (SELECT DISTINCT o_custkey AS speaker, o_custkey || '.' || l_orderkey || '.' || (1 + l_linenumber % 2) || '.wav' AS file, o_custkey || '.' || l_orderkey || '.wav' AS name FROM lineitem JOIN orders ON o_orderkey = l_orderkey)"
_LINES = """t AS (SELECT o_custkey AS speaker, o_orderkey * 2 + 1 AS line, o_custkey || '.' || o_orderkey || '.wav' || chr(9) || o_orderpriority AS value FROM orders WHERE o_orderkey % 5 <> 0
  UNION ALL SELECT o_custkey, o_orderkey * 2 - 40, 'see 1' || o_custkey || '.' || o_orderkey || '.wav again' || chr(9) || o_orderstatus FROM orders WHERE o_orderkey % 7 = 0)"""


@query(
    "attach_transcript",
    f"""WITH {_NAMES}, {_LINES}, f AS (SELECT s.speaker, s.name, arg_min(t.value, t.line) AS value FROM (SELECT DISTINCT speaker, name FROM s) s JOIN t ON t.speaker = s.speaker AND contains(t.value, s.name) GROUP BY 1, 2)
    SELECT s.speaker, s.file, coalesce(trim(f.value), '') AS text FROM s LEFT JOIN f USING (speaker, name)""",
)
def attach_transcript(spark, sf_dir):
    """Generated files find the first line of their customer's transcript that names the genuine file; some lines name others' in passing."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    speaker, key = F.col("o_custkey"), F.col("o_orderkey")
    name = F.concat_ws(".", speaker, key)
    files = spark.read.parquet(f"{sf_dir}/lineitem.parquet").join(orders, F.col("l_orderkey") == key)
    files = files.select(speaker.alias("speaker"), F.concat(name, F.lit("."), (1 + F.col("l_linenumber") % 2).cast("string"), F.lit(".wav")).alias("file")).distinct()
    own = orders.where("o_orderkey % 5 <> 0").select(speaker.alias("speaker"), (key * 2 + 1).alias("line"), F.concat(name, F.lit(".wav\t"), "o_orderpriority").alias("value"))
    passing = orders.where("o_orderkey % 7 = 0").select(speaker, key * 2 - 40, F.concat(F.lit("see 1"), name, F.lit(".wav again\t"), "o_orderstatus"))
    return attach.attach_transcript(files, own.union(passing))


@query("exclusion_map", "SELECT doc_id FROM documents WHERE source IS NULL OR NOT starts_with(source, 'src1')")
def exclusion_map(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source")
    return attach.without_excluded(docs.select("doc_id"), docs, F.col("source").startswith("src1"), ["doc_id"])


@query("quarantine_plan", f"WITH {_C}, t AS (SELECT DISTINCT o_custkey AS speaker, o_orderkey::VARCHAR AS stem FROM orders WHERE o_orderstatus = 'P'), f AS (SELECT speaker, stem, unnest(['.wav', '.1.wav', '.2.wav']) AS x FROM t), x AS (SELECT DISTINCT o_custkey AS speaker, l_orderkey || '.' || l_linenumber || '.wav' AS file FROM lineitem JOIN orders ON o_orderkey = l_orderkey) SELECT 'raw/' || f.speaker || '/' || stem || f.x AS src, 'out/raw/' || f.speaker || '/' || stem || f.x AS dst, 'move' AS action FROM f JOIN x ON x.speaker = f.speaker AND x.file = stem || f.x")
def quarantine_plan(spark, sf_dir):
    """What would be moved of orders without a genuine clip."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    targets = orders.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("speaker"), F.col("o_orderkey").cast("string").alias("stem"))
    spoof = clips(spark, sf_dir)[1]
    return attach.quarantine_plan(targets, spoof.select(F.lit("raw").alias("root"), "speaker", F.concat("id", F.lit(".wav")).alias("file")), ["raw", "processed"], "out")


@query("model_alignment", "SELECT event_id AS id, CASE WHEN event_id % 11 = 0 THEN 'a' ELSE 'b' END AS models, CASE WHEN event_id % 11 = 0 THEN 'b' ELSE 'a' END AS missing FROM events WHERE event_id % 11 = 0 OR event_id % 13 = 0 AND event_id % 11 <> 0")
def model_alignment(spark, sf_dir):
    """Ids that one of two models lacks."""
    ids = scored(spark, sf_dir).select("id")
    a, b = ids.where("id % 13 <> 0 or id % 11 = 0").withColumn("model", F.lit("a")), ids.where("id % 11 <> 0").withColumn("model", F.lit("b"))
    return attach.model_alignment(a.union(b), unique=True)


@query("symmetric_difference", f"WITH {_C}, a AS (SELECT DISTINCT stem FROM kept WHERE method = 'A'), r AS (SELECT DISTINCT stem FROM kept WHERE method = 'R') SELECT stem, 'left' AS side FROM a WHERE stem NOT IN (SELECT stem FROM r) UNION ALL SELECT stem, 'right' FROM r WHERE stem NOT IN (SELECT stem FROM a)")
def symmetric_difference(spark, sf_dir):
    """Genuine clips that only one of two systems has copied."""
    from ..operators import integrity

    kept = integrity.paired(*clips(spark, sf_dir))
    return attach.symmetric_difference(kept.where("method = 'A'"), kept.where("method = 'R'"), "stem")


@query("set_equality", f"""WITH {_C}, x AS (SELECT method, stem FROM kept), m AS (SELECT DISTINCT method FROM kept),
  d AS (SELECT a.method AS one, b.method AS other, (SELECT count(*) FROM (SELECT stem FROM x WHERE x.method = a.method EXCEPT SELECT stem FROM x WHERE x.method = b.method))
    + (SELECT count(*) FROM (SELECT stem FROM x WHERE x.method = b.method EXCEPT SELECT stem FROM x WHERE x.method = a.method)) AS differing FROM m a JOIN m b ON a.method < b.method)
  SELECT one, other, differing, differing = 0 AS same FROM d""")
def set_equality(spark, sf_dir):
    """Every two systems by the genuine clips that they have copied."""
    from ..operators import integrity

    return attach.set_differences(integrity.paired(*clips(spark, sf_dir)), "method", "stem")
