"""Lines of keys and values read as a stream: the last line of a key wins, and what is not yet done stays on the work list.

State is one value for each key, the latest line's place and text, kept by `transformWithState`. Every batch writes the keys that it
changed to a folder of its own, so a batch that is repeated after a restart writes the same rows; the table is the
last change of each key. Lines are in order of their file's name, then of their place in it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..sources.logs import key_value

CHANGES = "key string, value string, file string, line long"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def line_stream(spark: SparkSession, folder: str, separator: str = " - ", files_per_batch: int = 100) -> DataFrame:
    """(key, value, file, line) of the folder's text files as a stream; malformed lines are skipped. A file is one row at first, to number its lines."""
    files = spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(folder, wholetext=True)
    lines = files.select(F.col("_metadata.file_name").alias("file"), F.posexplode(F.split("value", r"\r?\n")).alias("line", "value"))
    pairs = lines.select("file", F.col("line").cast("long").alias("line"), key_value(F.col("value"), separator).alias("p"))
    return pairs.where("p is not null and p.key <> '' and p.value <> ''").select("p.key", "p.value", "file", "line")


class _LastWins(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("held", "value string, file string, line long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        before = self.held.get() if self.held.exists() else None
        last = before and (before[1], before[2], before[0])
        for part in rows:
            top = max(zip(part["file"], part["line"].astype(int), part["value"]))
            last = top if last is None else max(last, top)
        file, line, value = last
        if before is None or (before[1], before[2]) != (file, line):
            self.held.update((value, file, int(line)))
            yield pd.DataFrame({"key": [key[0]], "value": [value], "file": [file], "line": [int(line)]})

    def close(self) -> None:
        pass


def changes(lines: DataFrame) -> DataFrame:
    """(key, value, file, line) whenever a later line of a key comes; lines that come late change nothing."""
    return lines.groupBy("key").transformWithStateInPandas(_LastWins(), outputStructType=CHANGES, outputMode="Update", timeMode="None")


def run_once(spark: SparkSession, folder: str, table: str, progress: str, done: DataFrame | None = None, **options) -> DataFrame:
    """Reads what is new in the folder and gives the table's (key, value) so far, less the keys of `done`.

    `done` is a static table (key): it is joined as it is now, to every batch's changes and to the table.
    """
    held = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    try:
        def keep(batch: DataFrame, number: int) -> None:
            batch.write.mode("overwrite").parquet(f"{table}/batch={number}")

        stream = changes(line_stream(spark, folder, **options))
        if done is not None:
            # stream-static anti join: a key that is done needs no row
            stream = stream.join(done.select("key"), "key", "left_anti")
        stream.writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", progress).trigger(availableNow=True).start().awaitTermination()
    finally:
        if held is not None:
            spark.conf.set("spark.sql.streaming.stateStore.providerClass", held)
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(table)
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], "key string, value string")
    rows = spark.read.schema(CHANGES).option("recursiveFileLookup", True).parquet(table)
    latest = rows.groupBy("key").agg(F.max_by("value", F.struct("file", "line")).alias("value"))
    return latest if done is None else latest.join(done.select("key"), "key", "left_anti")
