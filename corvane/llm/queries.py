"""One query for each operator of this folder over the bundled tables, with SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import warc

    return warc.round_trip(_table(spark, sf_dir, "pages")).drop("url")


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import lm
    from .textblocks import crc_mod

    documents = _table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", crc_mod("doc_id", 5) == 1)
    return lm.score(documents, ~F.col("held_out"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import decontam

    documents = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontam.find_phrases(documents, _table(spark, sf_dir, "benchmark"))
    return decontam.report(found)


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import suffix

    return suffix.remove_repeats(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import minhash

    return minhash.near_duplicates(_table(spark, sf_dir, "documents").select("doc_id", "text")).withColumnRenamed("id", "doc_id")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import langid
    from .textblocks import crc_mod

    documents = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", crc_mod("doc_id", 3) == 1)
    return langid.identify(documents, ~F.col("held_out"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import mixing

    return mixing.mix(_table(spark, sf_dir, "documents").select("doc_id", "text", "source")).drop("text", "source")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import toxicity
    from .textblocks import crc_mod

    documents = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(documents, _table(spark, sf_dir, "labels"), crc_mod("doc_id", 4) != 2)
    return toxicity.score(documents.withColumn("held_out", crc_mod("doc_id", 4) == 2), model).drop("text")


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import imatch

    return imatch.with_fingerprints(_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import urlfilter

    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    return urlfilter.judge(pages, urlfilter.labelled_urls(spark)).drop("url")


def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import importance

    drawn = importance.resample(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "benchmark"))
    return drawn.withColumnRenamed("id", "doc_id").drop("n_words")


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import merkle

    documents = _table(spark, sf_dir, "documents")
    return merkle.manifest(documents, altered={"text": merkle.lowered_where("text", "doc_id")}).withColumnRenamed("id", "doc_id")


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from . import packing

    documents = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.pack_documents(documents, public_tokenizers.path("word_bpe_49k.json")).withColumnRenamed("id", "doc_id")


def queries() -> dict:
    return {
        "op1_warc": op1_warc,
        "op2_lm_scoring": op2_lm_scoring,
        "op3_decontamination": op3_decontamination,
        "op4_suffix_dedup": op4_suffix_dedup,
        "op5_near_duplicates": op5_near_duplicates,
        "op6_language_id": op6_language_id,
        "op7_mixing": op7_mixing,
        "op8_toxicity": op8_toxicity,
        "op9_fingerprints": op9_fingerprints,
        "op10_url_filter": op10_url_filter,
        "op11_importance": op11_importance,
        "op12_merkle": op12_merkle,
        "op13_packing": op13_packing,
    }


def oracle_sql() -> dict[str, str]:
    from .oracles import BY_QUERY

    return dict(BY_QUERY)
