"""A grid of test conditions judged in one call, calibration first, in a run that can be cut off anywhere and goes on.

A run is a folder: `calibration` holds the threshold, `results` one partition for each condition, and `commits` one row for each
condition that is done. A condition's partition is written before its commit; a run that is started again skips what is committed for the same
input, and writes everything else anew, so a half-written partition never counts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import det, reports
from .stored import stored

COMMIT = "condition string, fingerprint long, rows long"
MEASURES = ("eer", "auc", "threshold", "source", "own_threshold", "mismatch", "tp", "fp", "tn", "fn", "acc", "bona_precision", "bona_recall", "bona_f1", "spoof_precision", "spoof_recall", "spoof_f1", "macro_f1")


def fingerprint(frame: DataFrame) -> tuple[int, int]:
    """(a sum of row hashes, rows): the same for the same rows in any order."""
    row = F.xxhash64(F.struct(*[F.col(f"`{c}`") for c in sorted(frame.columns)]))
    found = frame.agg(F.coalesce(F.sum(row.cast("decimal(20,0)")), F.lit(0)).alias("s"), F.count("*").alias("n")).first()
    return int(found["s"]) % (1 << 63), found["n"]


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    held = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)
    return spark.read.schema(schema).parquet(path) if held else spark.createDataFrame([], schema)


def judge(scored: DataFrame, system: str, threshold: DataFrame | None) -> DataFrame:
    """(system, measures...) of every system of one condition, at the given threshold, else at its own, which is labelled ORACLE."""
    return reports.calibrated(scored, system, threshold).select(F.col(system).alias("system"), *MEASURES)


def run(spark: SparkSession, folder: str, conditions: dict[str, Callable[[], DataFrame]], calibration: Callable[[], DataFrame] | None = None, system: str = "system") -> DataFrame:
    """(condition, system, measures...) of all conditions, each a function that gives (id, score, bona, system).

    Without a calibration, thresholds are each system's own. A condition without rows of a system gives no rows. Conditions that are in the folder, but not
    in this call, are left out of the result. A calibration that changed makes every condition new.
    """
    threshold, mark = None, 0
    if calibration is not None:
        rows = calibration().select("id", "score", "bona")
        mark, n = fingerprint(rows)
        held = _read(spark, f"{folder}/calibration", "threshold double, fingerprint long, rows long").where((F.col("fingerprint") == mark) & (F.col("rows") == n)).first()
        if held is None:
            found = det.eer(rows, []).select("threshold", F.lit(mark).cast("long").alias("fingerprint"), F.lit(n).cast("long").alias("rows"))
            found.coalesce(1).write.mode("overwrite").parquet(f"{folder}/calibration")
            held = spark.read.parquet(f"{folder}/calibration").first()
        threshold = spark.createDataFrame([(held["threshold"],)], "threshold double")
        if held["threshold"] is None:
            raise ValueError("a calibration needs rows of both classes")
    for name, load in conditions.items():
        rows = load().select("id", "score", "bona", F.col(system).alias("system"))
        own, n = fingerprint(rows)
        own = (own ^ mark) % (1 << 63)
        done = _read(spark, f"{folder}/commits", COMMIT).where((F.col("condition") == name) & (F.col("fingerprint") == own) & (F.col("rows") == n))
        if not done.isEmpty():
            continue
        out = judge(stored(rows, "condition"), "system", threshold).withColumn("condition", F.lit(name))
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("condition").parquet(f"{folder}/results")
        commit = spark.createDataFrame([(name, own, n)], COMMIT).withColumn("part", F.lit(name))
        commit.coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(f"{folder}/commits")
    schema = "system string, eer double, auc double, threshold double, source string, own_threshold double, mismatch boolean, tp long, fp long, tn long, fn long, " + ", ".join(f"{m} double" for m in MEASURES[10:]) + ", condition string"
    found = _read(spark, f"{folder}/results", schema)
    return found.where(F.col("condition").isin(*conditions)).select("condition", "system", *MEASURES)
