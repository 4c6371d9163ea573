"""Cutting lineage: tables written to the folder that driver and executors share, and components of graphs."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_folder


class Scratch:
    """Parquet tables under the shared folder; those of `drop` go when they are no longer read."""

    def __init__(self, spark: SparkSession, what: str):
        self.spark = spark
        self.folder = f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex}"
        self.n = 0

    def put(self, frame: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.folder}/{self.n}"
        frame.write.parquet(path)
        out = self.spark.read.schema(frame.schema).parquet(path)
        out._stored_at = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        jvm = self.spark.sparkContext._jvm
        for frame in frames:
            path = jvm.org.apache.hadoop.fs.Path(frame._stored_at)
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) for the nodes of an undirected graph of long (a, b); root is the smallest of the component.

    Alternates large-star and small-star steps: each hangs the neighbours of a node under the smallest,
    and the edge table never outgrows the graph. Nodes with very many neighbours are met by partial
    aggregates and by joins that adaptive execution can split.
    """
    now = scratch.put(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while not _is_star_forest(now):
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(joined.select("u", F.col("m").alias("v")))
        after = scratch.put(small.distinct())
        scratch.drop(now)
        now = after
    roots = now.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root")
    return roots.union(roots.select(F.col("root").alias("node"), "root").distinct())


def _is_star_forest(edges: DataFrame) -> bool:
    """Whether every node hangs under one other that hangs under none."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("a"), F.lit(0).alias("b")).union(edges.select("v", F.lit(0), F.lit(1)))
    return ends.groupBy("x").agg(F.sum("a").alias("a"), F.max("b").alias("b")).where("a > 1 or (a = 1 and b = 1)").isEmpty()
