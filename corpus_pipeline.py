"""From raw documents to a training mix: toxicity, near duplicates, repeated strings, benchmark text, mixing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of `docs`.
`run` writes what a stage keeps as Parquet in the folder that driver and executors share and gives it to the next.

Defined cases: every stage keeps rows with null ids, texts or sources as its operator defines them, works on empty
tables, and carries further columns along. Texts that a stage cuts have `n_chars` counted anew, where there is
such a column; a document that a cut leaves without text goes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import decontam, minhash, mixing, suffix, toxicity
from corvane.llm.stored import Scratch

#: SQL cannot express the classifier, the sketches and the suffix arrays; tests hold stages against brute force.
ORACLE_SQL = None


def _recounted(docs: DataFrame, columns: list[str]) -> DataFrame:
    if "n_chars" in columns:
        docs = docs.withColumn("n_chars", F.char_length("text").cast("long"))
    return docs.select(*[F.col(f"`{c}`") for c in columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on all labels, does not hold toxic."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), F.lit(True))
    return toxicity.score(docs, model).where("predicted = 0").select(*[F.col(f"`{c}`") for c in docs.columns])


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each group of near duplicates. Null ids stay.

    Rows of one id are one document: one row of it stays, that whose text has the smallest hash.
    """
    kept = minhash.near_duplicates(docs.select("doc_id", "text")).where("kept and id is not null").select(F.col("id").alias("doc_id")).distinct()
    columns = [F.col(f"`{c}`") for c in docs.columns]
    named = docs.join(kept.hint("merge"), "doc_id", "left_semi").groupBy("doc_id")
    one = named.agg(F.min_by(F.struct(*columns), F.struct(F.xxhash64("text"), "text")).alias("one")).select("one.*")
    return one.unionByName(docs.where("doc_id is null")).select(*columns)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the 50-byte strings that earlier documents hold; characters cut in part go whole."""
    cut = suffix.remove_repeats(docs, with_text=True)
    cut = cut.withColumn("text", F.col("kept_text").cast("string")).where("n_removed = 0 or text <> ''")
    return _recounted(cut, docs.columns)


def cut_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words that occur in a benchmark passage."""
    found = decontam.find_phrases(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _recounted(decontam.cut_spans(found.where("n_hit = 0 or n_hit < n_words")), docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with how many copies of each, and the words that come of them."""
    mixed = mixing.mix(docs).where("taken > 0")
    return mixed.withColumn("copies", (F.col("taken") / F.col("size")).cast("long"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", keep_one_of_near_duplicates),
    ("suffix_dedup", cut_repeats),
    ("decontamination", cut_benchmark),
    ("mixing", mix_sources),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table of documents."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = scratch.put(docs)
    return docs
