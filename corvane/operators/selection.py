"""Exact percentiles of groups of any size, by refining histograms; no buffer grows with a group.

A value's key is a whole number of 64 bits in the order of the values. Four passes count keys by their next 16 bits, each
only among the keys that share the bits found so far; the counts before a bucket tell which one holds the row of a
wanted rank. So a pass leaves at most 65,536 counts for each group and rank, summed where the rows are, and the last one leaves the
value. All passes are one plan: what is searched for travels with the counts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .stored import stored

SHIFTS = (48, 32, 16, 0)


_REST = np.int64(0x7FFFFFFFFFFFFFFF)


def keys_of(values: np.ndarray) -> np.ndarray:
    """The keys of doubles: 0 for both zeros, NaN after infinity."""
    bits = np.where(np.isnan(values), np.nan, values + 0.0).view(np.int64)
    return bits ^ ((bits >> 63) & _REST)


def keyed(frame: DataFrame, value: str, key: str = "__key") -> DataFrame:
    """The frame's other columns with the key of a numeric column; null values are left out."""
    rows = frame.where(F.col(value).isNotNull()).withColumn(value, F.col(value).cast("double"))
    others = [c for c in frame.columns if c != value]
    schema = rows.select(*others).schema.add(key, "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = keys_of(batch.column(value).to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in others), pa.array(keys, pa.int64())], names=[*others, key])

    return rows.select(*others, value).mapInArrow(run, schema)


@F.arrow_udf(DoubleType())
def unkeyed(key: pa.Array) -> pa.Array:
    # from an array, since a series would lose NaN to null
    k = key.to_numpy(zero_copy_only=False).astype(np.int64)
    return pa.array((k ^ ((k >> 63) & _REST)).view(np.float64))


def _same(left: DataFrame, right: DataFrame, groups: list[str]) -> tuple[DataFrame, Column]:
    """The right frame with its groups renamed, and the condition that groups agree, nulls too."""
    on = F.lit(True)
    for g in groups:
        right = right.withColumnRenamed(g, f"__of_{g}")
        on = on & F.col(g).eqNullSafe(F.col(f"__of_{g}"))
    return right, on


def by_counts(sizes: DataFrame, groups: list[str], points: dict[str, float], counted: Callable[[DataFrame, int], DataFrame]) -> DataFrame:
    """(groups..., a double for each of `points`) from counts of keys.

    `sizes` has the groups and how many values `n` each has. `counted(wanted, shift)` takes (groups..., __prefix, __ranks), and returns (groups...,
    __prefix, __ranks, __bucket, __n): how many keys with `key >> (shift + 16)` = __prefix have `key >> shift` = __bucket; there is no prefix at first.
    """
    places = [F.lit(p) * (F.col("n") - 1) for p in points.values()]
    ranks = F.array_distinct(F.array(*[f(h).cast("long") for h in places for f in (F.floor, F.ceil)]))
    wanted = sizes.select(*groups, F.lit(0).cast("long").alias("__prefix"), F.transform(ranks, lambda r: F.struct(r.alias("rank"), r.alias("left"), F.col("n").alias("n"))).alias("__ranks"))
    for shift in SHIFTS:
        found = counted(wanted, shift)
        earlier = Window.partitionBy(*groups, "__prefix").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
        found = found.withColumn("__before", F.coalesce(F.sum("__n").over(earlier), F.lit(0)))
        inside = F.filter("__ranks", lambda r: (r["left"] >= F.col("__before")) & (r["left"] < F.col("__before") + F.col("__n")))
        inside = F.transform(inside, lambda r: F.struct(r["rank"].alias("rank"), (r["left"] - F.col("__before")).alias("left"), r["n"].alias("n")))
        wanted = found.select(*groups, F.col("__bucket").alias("__prefix"), inside.alias("__ranks")).where(F.size("__ranks") > 0)
    each = wanted.withColumn("__value", unkeyed(F.col("__prefix"))).select(*groups, "__value", F.explode("__ranks").alias("r"))
    by = each.groupBy(*groups).agg(F.map_from_entries(F.collect_list(F.struct(F.col("r.rank"), "__value"))).alias("__at"), F.max("r.n").alias("n"))
    out = []
    for name, p in points.items():
        h = F.lit(p) * (F.col("n") - 1)
        low, high, part = F.col("__at")[F.floor(h).cast("long")], F.col("__at")[F.ceil(h).cast("long")], h - F.floor(h)
        # equal ends need no step, which infinite ones could not take
        out.append(F.when(low == high, low).otherwise(low + (high - low) * part).alias(name))
    return by.select(*groups, *out)


def percentiles(frame: DataFrame, groups: list[str], value: str, points: dict[str, float]) -> DataFrame:
    """(groups..., a double for each named point between 0 and 1): between two values by linear interpolation.

    Null values don't count: a group without others is left out, and a table without any gives one row of nulls where there
    are no groups. NaN is the largest value.
    """
    rows = stored(keyed(frame.select(*groups, F.col(value).alias("__v")), "__v").drop("__v"), "selection")
    sizes = rows.groupBy(*groups).agg(F.count("*").alias("n")).where("n > 0")

    def counted(wanted: DataFrame, shift: int) -> DataFrame:
        right, on = _same(rows, wanted, groups)
        held = rows.withColumn("__bucket", F.shiftright("__key", shift))
        if shift == SHIFTS[0]:
            counts = held.groupBy(*groups, "__bucket").agg(F.count("*").alias("__n"))
            return counts.join(right, on).select(*groups, "__prefix", "__ranks", "__bucket", "__n")
        # what is wanted goes to the rows that share its bits, and is counted with them
        held = held.join(right, on & (F.shiftright("__key", shift + 16) == F.col("__prefix")))
        return held.groupBy(*groups, "__prefix", "__bucket").agg(F.first("__ranks").alias("__ranks"), F.count("*").alias("__n"))

    return by_counts(sizes, groups, points, counted)


def medians(frame: DataFrame, columns: list[str]) -> DataFrame:
    """One row with the exact median of each column."""
    long = frame.select(F.explode(F.array(*[F.struct(F.lit(i).alias("__c"), F.col(c).cast("double").alias("__v")) for i, c in enumerate(columns)])).alias("x")).select("x.*")
    found = percentiles(long, ["__c"], "__v", {"__m": 0.5})
    return found.agg(*[F.max(F.when(F.col("__c") == i, F.col("__m"))).alias(c) for i, c in enumerate(columns)])
