"""Reproducible sampling: every draw orders rows by an md5 of seed and key, so that it repeats in any engine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def draw(seed: str, key: str) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}-"), F.col(key).cast("string")).cast("binary"))


def half_even(x: Column) -> Column:
    return F.bround(x, 0).cast("long")


def ranked(frame: DataFrame, strata: list[str], seed: str, key: str, length: str | None = None) -> DataFrame:
    """Place `__rn` in the stratum's draw and its size `__n`; with `length`, the total `__ahead` of it in the rows drawn before.

    A draw is cut into 4096 slices by its first digits, so that many tasks rank one big stratum: a row's place is its
    place in its slice after the counts of earlier slices, of which a stratum has 4096 at most.
    """
    rows = frame.withColumn("__h", draw(seed, key)).withColumn("__slice", F.substring("__h", 1, 3))
    over = Window.partitionBy(*[f"__in_{s}" for s in strata])
    earlier = over.orderBy("__of").rowsBetween(Window.unboundedPreceding, -1)
    total = F.lit(0) if length is None else F.col(length)
    counts = rows.groupBy(*[F.col(s).alias(f"__in_{s}") for s in strata], F.col("__slice").alias("__of")).agg(F.count("*").alias("__m"), F.sum(total).alias("__l"))
    counts = counts.withColumn("__before", F.coalesce(F.sum("__m").over(earlier), F.lit(0))).withColumn("__before_l", F.coalesce(F.sum("__l").over(earlier), F.lit(0)))
    counts = counts.withColumn("__n", F.sum("__m").over(over)).drop("__m", "__l")
    on = F.col("__slice").eqNullSafe(F.col("__of"))
    for s in strata:
        on = on & F.col(s).eqNullSafe(F.col(f"__in_{s}"))
    within = Window.partitionBy(*strata, "__slice").orderBy("__h", key)
    out = rows.join(counts, on).withColumn("__rn", F.row_number().over(within) + F.col("__before"))
    if length is not None:
        out = out.withColumn("__ahead", F.coalesce(F.sum(length).over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.col("__before_l"))
    return out.drop("__h", "__slice", "__of", "__before", "__before_l", *[f"__in_{s}" for s in strata])


def drawn_first(frame: DataFrame, strata: list[str], seed: str, key: str, n: int) -> DataFrame:
    """The first n rows of each stratum's draw, with their place `__rn`; tasks drop what cannot be among them before the shuffle."""
    return frame.withColumn("__rn", F.row_number().over(Window.partitionBy(*strata).orderBy(draw(seed, key), key))).where(F.col("__rn") <= n)


def split_members(members: DataFrame, stratum: str, key: str, *, train: float = 0.70, val: float = 0.15, seed: str = "42") -> DataFrame:
    """Add `split`: shares of each stratum rounded half to even, one at least for val and test from three members on."""
    rows = ranked(members, [stratum], seed, key)
    n = F.col("__n")
    n_train, n_val = half_even(n * train), half_even(n * val)
    n_train = F.when(n >= 3, F.least(n_train, n - 2)).otherwise(n_train)
    n_val = F.when(n >= 3, F.greatest(F.lit(1), F.least(n_val, n - n_train - 1))).otherwise(n_val)
    split = F.when(F.col("__rn") <= n_train, "train").when(F.col("__rn") <= n_train + n_val, "val").otherwise("test")
    return rows.withColumn("split", split).drop("__rn", "__n")


def stratified(frame: DataFrame, stratum: str, key: str, fraction: float, seed: str) -> DataFrame:
    """Add `selected`: the first of each stratum's draw, a share rounded half to even."""
    rows = ranked(frame, [stratum], seed, key)
    return rows.withColumn("selected", F.col("__rn") <= half_even(F.col("__n") * fraction)).drop("__rn", "__n")


def balanced(frame: DataFrame, label: str, key: str, n: int, seed: str) -> DataFrame:
    """At most n rows, half of each class; all rows if n is 0 or they are no more than n."""
    total = frame.count()
    if n <= 0 or total <= n:
        return frame
    return drawn_first(frame, [label], seed, key, max(1, n // 2)).drop("__rn")


def per_group_share(frame: DataFrame, group: str, key: str, fraction: float, target: int, seed: str) -> DataFrame:
    """A share of each group, one at least, then trimmed or topped up to exactly `target` rows where there are so many."""
    rows = ranked(frame, [group], seed, key)
    chosen = F.col("__rn") <= F.greatest(F.lit(1), half_even(F.col("__n") * fraction))
    rows = rows.withColumn("__share", chosen).drop("__rn", "__n")
    # the share comes first and the others fill up, each in the order of one draw over all groups
    size = rows.agg(F.count_if("__share").alias("__size"))
    room = F.when(F.col("__share"), F.lit(target)).otherwise(target - F.col("__size"))
    return ranked(rows, ["__share"], seed, key).crossJoin(F.broadcast(size)).where(F.col("__rn") <= room).select(*frame.columns)


def quotas(counts: dict[str, int], shares: dict[str, float], total: int) -> dict[str, int]:
    """Shares of a total, the last bin's being what the others leave, capped by what there is; what is left goes one by one to the bin with most room."""
    *first, last = shares
    due = {b: round(total * shares[b]) for b in first}
    due[last] = total - sum(due.values())
    out = {b: min(counts.get(b, 0), max(0, n)) for b, n in due.items()}
    left = min(total, sum(counts.get(b, 0) for b in shares)) - sum(out.values())
    while left > 0:
        room = {b: counts.get(b, 0) - out[b] for b in shares}
        widest = max(shares, key=lambda b: room[b])
        if room[widest] <= 0:
            break
        out[widest] += 1
        left -= 1
    return out


def quota_sample(frame: DataFrame, bin_: str, key: str, shares: dict[str, float], total: int, seed: str) -> DataFrame:
    counts = {r[0]: r[1] for r in frame.groupBy(bin_).count().collect()}
    due = quotas(counts, shares, total)
    limit = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for b, n in due.items() for x in (b, n)]), F.col(bin_)), F.lit(0))
    return drawn_first(frame, [bin_], seed, key, max(due.values(), default=0)).where(F.col("__rn") <= limit).drop("__rn")


def greedy_cover(frame: DataFrame, group: str, key: str, length: str, *, target: float, least: int = 1, most: int = 5, seed: str = "cover") -> DataFrame:
    """For each group, rows of its draw until `least` rows reach `target`, `most` rows at most.

    If `most` - 1 rows do not reach it, the last place goes to the smallest remaining row that covers the gap,
    else to the largest.
    """
    rows = ranked(frame, [group], seed, key)
    ahead = F.coalesce(F.sum(length).over(Window.partitionBy(group).orderBy("__rn").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    head = rows.where(F.col("__rn") < most)
    body = head.withColumn("__ahead", ahead).where((F.col("__ahead") < target) | (F.col("__rn") <= least)).withColumn("place", F.col("__rn").cast("int"))
    # groups whose first places fall short
    short = head.groupBy(group).agg(F.sum(length).alias("__got"), F.count("*").alias("__m")).where((F.col("__got") < target) & (F.col("__m") == most - 1))
    tail = rows.where(F.col("__rn") >= most).join(short.select(group, "__got"), group).withColumn("__gap", target - F.col("__got"))
    covers = F.col(length) >= F.col("__gap")
    order = F.struct(F.when(covers, 0).otherwise(1), F.when(covers, F.col(length)).otherwise(-F.col(length)), "__rn")
    last = tail.groupBy(group).agg(F.min_by(F.struct(*frame.columns), order).alias("__one")).select("__one.*", F.lit(most).alias("place"))
    return body.select(*frame.columns, "place").unionByName(last.select(*frame.columns, "place"))


def reference(frame: DataFrame, group: str, key: str, length: str, *, target: float, usable: Column, seed: str = "reference") -> DataFrame:
    """For each group the usable rows of its draw until their lengths reach the target: rows before which less than that had come."""
    rows = ranked(frame.where(usable), [group], seed, key, length)
    return rows.where(F.col("__ahead") < target).select(*frame.columns, F.col("__rn").cast("long").alias("place"))


def at_most(frame: DataFrame, group: str, key: str, n: int, seed: str) -> DataFrame:
    """At most n rows of each group, the first of its draw."""
    return drawn_first(frame, [group], seed, key, n).select(*frame.columns)


def derangement(frame: DataFrame, group: str, key: str, seed: str) -> DataFrame:
    """(group, source, target): a one-to-one map without fixed points in each group of two or more."""
    rows = ranked(frame, [group], seed, key)
    rows = rows.where("__n >= 2").select(group, key, "__rn", "__n")
    after = rows.select(F.col(group).alias("__g"), F.col(key).alias("target"), F.col("__rn").alias("__at"))
    pairs = rows.join(after, F.col(group).eqNullSafe(F.col("__g")) & (F.col("__rn") % F.col("__n") + 1 == F.col("__at")))
    return pairs.select(group, F.col(key).alias("source"), "target")


def page(frame: DataFrame, key: str, number: int, size: int = 30) -> DataFrame:
    """The rows of a page, counted from 1, of the table ordered by key."""
    return frame.orderBy(key).offset((number - 1) * size).limit(size)


def leave_one_out(rows: DataFrame, held: str, *, system: str, split: str, pool: DataFrame) -> DataFrame:
    """Train and val without the held-out system, test with it alone, each with the genuine twins of its spoofs."""
    spoof = rows.where(((F.col(split) != "test") & (F.col(system) != held)) | ((F.col(split) == "test") & (F.col(system) == held)))
    twins = pool.join(spoof.select("stem").distinct(), "stem", "left_semi")
    return spoof.unionByName(twins)
