"""Tables written to the folder that driver and executors share, where a plan reads one more than once."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from ..session import shared_folder


def stored(frame: DataFrame, what: str) -> DataFrame:
    """The frame as written Parquet: it survives lost executors, and its rows stay as they are however often they are read."""
    spark = frame.sparkSession
    path = f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex}"
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)
