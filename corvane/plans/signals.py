"""Vector, audio, probe and stream queries. Vectors are `embeddings`, labels stand for speakers."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import audio
from ..operators import det, probe, selection, vectors
from ..operators.stored import stored
from ..session import shared_folder
from ..streaming import counts
from .catalogue import query


def vecs(spark, sf_dir) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return e.select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("vector"))


_V = "v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS vector FROM embeddings)"
_UNIT = "(CASE WHEN sqrt(list_dot_product({0}, {0})) > 0 THEN list_transform({0}, lambda x: x / sqrt(list_dot_product({0}, {0}))) ELSE {0} END)"
_CENT = f"{_V}, cd AS (SELECT label, d, avg(vector[d]) AS m FROM v, (SELECT unnest(range(1, 65)) AS d) GROUP BY 1, 2), ce AS (SELECT label, list(m ORDER BY d) AS c FROM cd GROUP BY 1)"


@query("centroid", f"WITH {_CENT} SELECT label, d::BIGINT AS dimension, round(m, 6) AS mean FROM cd")
def centroid(spark, sf_dir):
    means = vectors.mean_vector(vecs(spark, sf_dir), ["label"], "vector")
    return means.select("label", F.posexplode("mean").alias("d", "mean")).select("label", (F.col("d") + 1).cast("long").alias("dimension"), F.round("mean", 6).alias("mean"))


_RANK = f"""{_CENT}, mu AS (SELECT list(m ORDER BY d) AS mu FROM (SELECT d, avg(c[d]) AS m FROM ce, (SELECT unnest(range(1, 65)) AS d) GROUP BY 1)),
  gc AS (SELECT label, list_transform(list_zip(c, mu), lambda z: z[1] - z[2]) AS c FROM ce, mu), gal AS (SELECT label, {_UNIT.format('c')} AS g FROM gc),
  pc AS (SELECT vec_id, label, list_transform(list_zip(vector, mu), lambda z: z[1] - z[2]) AS c FROM v, mu), pr AS (SELECT vec_id AS probe, label, {_UNIT.format('c')} AS p FROM pc),
  rk AS (SELECT probe, pr.label AS own, gal.label AS member, round(list_dot_product(p, g), 9) AS sim FROM pr, gal), rr AS (SELECT *, row_number() OVER (PARTITION BY probe ORDER BY sim DESC, member) AS rank FROM rk)"""


def _ranks(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """((probe, own, rank), the gallery)"""
    rows = vecs(spark, sf_dir)
    means = vectors.mean_vector(rows, ["label"], "vector").withColumnRenamed("mean", "vector")
    middle = vectors.mean_vector(means, [], "vector")
    shift = lambda x: x.crossJoin(F.broadcast(middle)).withColumn("vector", vectors.unit(F.zip_with("vector", "mean", lambda a, m: a - m))).drop("mean")
    probes = shift(rows).select(F.col("vec_id").alias("probe"), F.col("label").alias("own"), "vector")
    return vectors.own_ranks(probes, shift(means)), means


@query("centred_rank", f"WITH {_RANK} SELECT probe, own, rank FROM rr WHERE member = own")
def centred_rank(spark, sf_dir):
    """Where each probe's own label ranks in the gallery of centred centroids."""
    return _ranks(spark, sf_dir)[0]


@query("identity_probe", f"WITH {_RANK}, o AS (SELECT * FROM rr WHERE member = own) SELECT count(*) AS probes, median(rank)::DOUBLE AS median_rank, count(*) FILTER (rank <= 5) AS in_top_5, ((SELECT count(*) FROM gal) + 1) / 2.0::DOUBLE AS chance, median(rank) < ((SELECT count(*) FROM gal) + 1) / 2.0 AS better FROM o")
def identity_probe(spark, sf_dir):
    ranked, gallery = _ranks(spark, sf_dir)
    ranked = stored(ranked, "ranks")
    out = ranked.agg(F.count("*").alias("probes"), F.count_if(F.col("rank") <= 5).alias("in_top_5"))
    out = out.crossJoin(F.broadcast(selection.percentiles(ranked, [], "rank", {"median_rank": 0.5})))
    out = out.select("probes", "median_rank", "in_top_5").crossJoin(F.broadcast(gallery.agg(F.count("*").alias("n")))).withColumn("chance", (F.col("n") + 1) / 2.0).drop("n")
    return out.withColumn("better", F.col("median_rank") < F.col("chance"))


@query("median_pairwise", f"WITH {_CENT}, u AS (SELECT label, {_UNIT.format('c')} AS x FROM ce) SELECT 'labels' AS pool, count(*) AS pairs, round(median(list_dot_product(a.x, b.x)), 6) AS median FROM u a JOIN u b ON a.label < b.label")
def median_pairwise(spark, sf_dir):
    """Of the labels' centroids."""
    means = vectors.mean_vector(vecs(spark, sf_dir), ["label"], "vector")
    rows = means.select(F.lit("labels").alias("pool"), "label", vectors.unit(F.col("mean")).alias("vector"))
    return vectors.median_pairwise(rows, "pool", "label", "vector").withColumn("median", F.round("median", 6))


@query("pearson_abs", f"WITH {_V}, p AS (SELECT a.vec_id, unnest(a.vector) AS x, unnest(b.vector) AS y FROM v a JOIN v b ON b.vec_id = a.vec_id + 1) SELECT vec_id, round(abs(corr(x, y)), 6) AS r FROM p GROUP BY 1")
def pearson_abs(spark, sf_dir):
    """Each vector against the next."""
    rows = vecs(spark, sf_dir)
    after = rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("vector").alias("next"))
    return rows.join(after, "vec_id").select("vec_id", F.round(vectors.pearson_abs(F.col("vector"), F.col("next"), least=10), 6).alias("r"))


@query("probe_logreg")
def probe_logreg(spark, sf_dir):
    """Error rate of a probe for document quality from length features."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").join(spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality"), "doc_id")
    words = F.regexp_count("text", F.lit(r"\S+"))
    d = d.select("doc_id", "quality", F.col("n_chars").cast("double").alias("chars"), words.cast("double").alias("words"), (F.col("n_chars") / F.greatest(words, F.lit(1))).alias("mean_word"), F.regexp_count("text", F.lit(r"\p{Lu}")).cast("double").alias("capitals"))
    scored = probe.fit_probe(d.where("doc_id % 2 = 0"), d.where("doc_id % 2 = 1"), ["chars", "words", "mean_word", "capitals"], "quality")
    rows = scored.select(F.col("doc_id").alias("id"), F.col("probability").alias("score"), (F.col("quality") == 1).alias("bona"))
    return det.descending_eer(rows, []).withColumn("verdict", det.verdict(F.col("eer")))


def _waves(spark, sf_dir) -> DataFrame:
    # rows are few and small for the work in them, so one file of them is dealt to as many tasks as the session has partitions
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "s_suppkey")
    return audio.tones(s.select("s_suppkey", (200 + F.col("s_suppkey") % 40 * 100).cast("double").alias("hz"), (0.5 + F.col("s_nationkey") % 3 * 0.25).cast("double").alias("seconds")), "hz", "seconds")


@query("audio_features")
def audio_features(spark, sf_dir):
    return audio.features(_waves(spark, sf_dir)).drop("mfcc")


@query("normalise_chain")
def normalise_chain(spark, sf_dir):
    return audio.normalise(_waves(spark, sf_dir)).drop("content")


@query("stream_counts", "SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_counts(spark, sf_dir):
    """The table as a stream of files, read to its end, with its counts kept in the shared folder."""
    # a pattern, since a stream of files takes a single file only by one
    source, folder = f"{sf_dir}/[e]vents.parquet", f"{shared_folder(spark)}/events-{uuid.uuid4().hex}"
    rows = counts.run_once(spark, source, spark.read.parquet(f"{sf_dir}/events.parquet").schema, f"{folder}/counts", f"{folder}/progress")
    return rows.withColumn("start", F.col("start").cast("timestamp_ntz"))


def _silent(batches):
    """The first bytes of wave files of digital silence, and how many zeros follow."""
    import struct

    import pyarrow as pa

    for batch in batches:
        heads, zeros = [], []
        for rate, channels, frames in zip(*(batch.column(c).to_pylist() for c in ("rate", "channels", "frames"))):
            n = 2 * channels * frames
            heads.append(struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + n, b"WAVE", b"fmt ", 16, 1, channels, rate, 2 * channels * rate, 2 * channels, 16, b"data", n))
            zeros.append(n)
        yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(heads, pa.binary()), pa.array(zeros, pa.int64())], names=["path", "content", "zeros"])


@query(
    "audio_header_scan",
    """WITH w AS (SELECT *, CASE s_suppkey % 3 WHEN 0 THEN 8000 WHEN 1 THEN 16000 ELSE 44100 END AS rate FROM supplier WHERE s_nationkey IN (1, 3, 7))
    SELECT s_suppkey::VARCHAR AS id, 'n' || s_nationkey AS speaker_id, round((400 + 16 * s_suppkey)::DOUBLE / rate, 3) AS duration_sec, rate::INTEGER AS sample_rate, (1 + s_suppkey % 2)::INTEGER AS channels, 'PCM_16' AS subtype, 'WAV' AS container, true AS valid FROM w""",
)
def audio_header_scan(spark, sf_dir):
    """A wave file for each supplier is written to the shared folder; the headers of three nations' folders are read back.

    Clips grow with the key, so their samples, all zeros, are never held and take no local disk.
    """
    from ..sources import sinks, tables

    s = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    key = F.col("s_suppkey")
    made = s.select(
        F.concat(F.lit("n"), F.col("s_nationkey").cast("string"), F.lit("/"), key.cast("string"), F.lit(".wav")).alias("path"),
        F.when(key % 3 == 0, 8000).when(key % 3 == 1, 16000).otherwise(44100).alias("rate"), (1 + key % 2).cast("int").alias("channels"), (400 + 16 * key).alias("frames"),
    )
    root = f"{shared_folder(spark)}/waves-{uuid.uuid4().hex}"
    stored(sinks.write_audio(made.mapInArrow(_silent, "path string, content binary, zeros long"), root, zeros="zeros"), "written")
    rows = tables.audio_inventory(spark, root).where(F.col("speaker_id").isin("n1", "n3", "n7"))
    return rows.select("id", "speaker_id", "duration_sec", "sample_rate", "channels", "subtype", "container", "valid")


@query(
    "worklist_stream",
    """WITH l AS (SELECT user_id::VARCHAR AS key, arg_max(event_type || ' - ' || event_id, event_id) AS value FROM events WHERE event_id % 50 <> 7 GROUP BY 1)
    SELECT key, value FROM l WHERE key NOT IN (SELECT c_custkey::VARCHAR FROM customer WHERE c_custkey % 3 = 0)""",
)
def worklist_stream(spark, sf_dir):
    """Lines `user - event`, some of them malformed, in files that a stream reads: the last line of each user, less those that are done."""
    from ..streaming import latest

    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    sign = F.when(F.col("event_id") % 50 == 7, " ").otherwise(" - ")
    line = F.concat(F.col("user_id").cast("string"), sign, "event_type", F.when(F.col("event_id") % 50 == 7, " ").otherwise(" - "), F.col("event_id").cast("string"))
    base = f"{shared_folder(spark)}/lines-{uuid.uuid4().hex}"
    # a file is read by one task, so there are as many as the session has partitions, read in two batches
    files = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    e.repartitionByRange(files, "event_id").sortWithinPartitions("event_id").select(line.alias("value")).write.text(f"{base}/in")
    done = spark.read.parquet(f"{sf_dir}/customer.parquet").where("c_custkey % 3 = 0").select(F.col("c_custkey").cast("string").alias("key"))
    return latest.run_once(spark, f"{base}/in", f"{base}/table", f"{base}/progress", done, files_per_batch=-(-files // 2))
