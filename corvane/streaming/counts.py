"""Incremental counts by event type and window, with late data bounded by a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, *, time: str = "ts", kind: str = "event_type", window: str = "1 day", late: str = "2 days") -> DataFrame:
    """Counts by window and kind; on a stream, windows that the watermark has passed are dropped from state."""
    stamped = events.withColumn("__t", F.col(time).cast("timestamp")).withWatermark("__t", late)
    counts = stamped.groupBy(F.window("__t", window).alias("w"), kind).agg(F.count("*").alias("n"))
    return counts.select(F.col("w.start").alias("start"), kind, "n")


def first_arrivals(events: DataFrame, key: str, *, time: str = "ts", late: str = "2 days") -> DataFrame:
    """The first arrival of each key; state is dropped when the watermark has passed."""
    return events.withColumn("__t", F.col(time).cast("timestamp")).withWatermark("__t", late).dropDuplicatesWithinWatermark([key]).drop("__t")


def run_once(spark: SparkSession, source: str, schema, target: str, checkpoint: str, **options) -> DataFrame:
    """Read what is new at the source, keep counts in the target folder, and return what they are now.

    Each batch adds its folder, with the counts up to then of the windows that it touched, or writes it anew when it is
    repeated after a failure. Of a window the latest batch holds; a window that the watermark has passed takes no more rows.
    """
    stream = spark.readStream.schema(schema).parquet(source)

    def put(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{target}/batch={number}")

    query = windowed_counts(stream, **options).writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    rows = spark.read.option("basePath", target).parquet(f"{target}/batch=*")
    keys = [c for c in rows.columns if c not in ("n", "batch")]
    return rows.groupBy(*keys).agg(F.max_by("n", "batch").alias("n"))
