"""Corpus audits: sources, extremes, cross tables, work lists and configuration diffs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ABSENT = "<absent>"


def by_source(rows: DataFrame, source: str, member: str, length: str) -> DataFrame:
    out = rows.groupBy(source).agg(F.count("*").alias("clips"), F.countDistinct(member).alias(f"{member}s"), F.sum(length).alias("total"))
    return out.withColumn("share", F.round(F.lit(100.0) * F.col("clips") / F.sum("clips").over(Window.partitionBy()), 6))


def extremes(rows: DataFrame, group: str, length: str, k: int) -> DataFrame:
    """The k groups of least and of most total length."""
    totals = rows.groupBy(group).agg(F.count("*").alias("clips"), F.sum(length).alias("total"))
    out = None
    for side, order in (("fewest", F.asc("total")), ("most", F.desc("total"))):
        top = totals.orderBy(order, group).limit(k)
        top = top.select(F.lit(side).alias("side"), F.row_number().over(Window.orderBy(order, group)).cast("long").alias("place"), group, "clips", "total")
        out = top if out is None else out.unionByName(top)
    return out


def crosstab(rows: DataFrame, value: str, label: str, share: float = 0.95) -> DataFrame:
    """Classes by value, and whether one class has more than `share` of a value while there are several values."""
    counts = rows.groupBy(F.col(value).alias("value")).agg(*[F.count_if(F.col(label) == k).alias(f"class_{k}") for k in (0, 1)])
    several = F.count("*").over(Window.partitionBy()) > 1
    top = F.try_divide(F.greatest("class_0", "class_1"), F.col("class_0") + F.col("class_1"))
    return counts.withColumn("lopsided", several & F.coalesce(top > share, F.lit(False)))


def missing(wanted: DataFrame, done: DataFrame, spared: DataFrame, key: list[str], scope: str) -> DataFrame:
    """Wanted, neither done nor spared, where the scope has something done."""
    return wanted.join(done, key, "left_anti").join(spared, key, "left_anti").join(done.select(scope), scope, "left_semi")


def worklist(chosen: DataFrame, done: DataFrame, group: str, key: str, first: int) -> DataFrame:
    """The first rows of each group, counted before those that are done are left out."""
    rows = chosen.withColumn("__rn", F.row_number().over(Window.partitionBy(group).orderBy(key))).where(F.col("__rn") <= first).drop("__rn")
    return rows.join(done, key, "left_anti")


def flatten(tree, prefix: str = "") -> dict[str, str]:
    """Dotted paths of a nested mapping; lists count as one value."""
    if isinstance(tree, dict) and tree:
        return {k: v for name, sub in tree.items() for k, v in flatten(sub, f"{prefix}{name}.").items()}
    return {prefix.rstrip("."): repr(tree)}


def rows_diff(left: DataFrame, right: DataFrame, allowed: tuple[str, ...]) -> DataFrame:
    """(key, left_value, right_value, allowed) of two configurations as rows (key, value): keys whose values differ, and whether they may, by their prefix."""
    one, two = left.select("key", F.col("value").alias("left_value")), right.select("key", F.col("value").alias("right_value"))
    both = one.join(two, "key", "full").where(~F.col("left_value").eqNullSafe(F.col("right_value")))
    ok = F.lit(False)
    for p in allowed:
        ok = ok | F.col("key").startswith(p)
    return both.select("key", F.coalesce("left_value", F.lit(ABSENT)).alias("left_value"), F.coalesce("right_value", F.lit(ABSENT)).alias("right_value"), ok.alias("allowed"))


def config_diff(spark: SparkSession, a: dict, b: dict, allowed: tuple[str, ...]) -> DataFrame:
    left, right = (spark.createDataFrame(sorted(flatten(x).items()), "key string, value string") for x in (a, b))
    return rows_diff(left, right, allowed)


def derived_config(base: dict, patch: dict[str, object], allowed: tuple[str, ...]) -> dict:
    """The base with dotted keys of `patch` set. A patch that moves a key outside `allowed`, or nothing, is an error."""
    import copy

    out = copy.deepcopy(base)
    for key, value in patch.items():
        *folders, last = key.split(".")
        at = out
        for f in folders:
            at = at.setdefault(f, {})
        at[last] = value
    before, after = flatten(base), flatten(out)
    moved = [k for k in before.keys() | after.keys() if before.get(k, ABSENT) != after.get(k, ABSENT)]
    if wrong := sorted(k for k in moved if not k.startswith(allowed)):
        raise ValueError(f"keys that may not change: {', '.join(wrong)}")
    if not moved:
        raise ValueError("the patch changes nothing")
    return out
