"""Detection curves, equal error rates, rank sums and confusion counts, all by group and in one sweep.

A scored table has the group columns, `id`, `score` and `bona` (true for the genuine class). A row rejects
its own threshold in the sweep; `confusion` accepts it. Ties follow the order of ids. A group with one class
only has null rates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .stored import stored


def ratio(a: Column, b: Column) -> Column:
    """a / b as doubles, null where b is 0."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def zero_safe(a: Column, b: Column) -> Column:
    return F.coalesce(ratio(a, b), F.lit(0.0))


def finite(x: Column) -> Column:
    return F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))


def _cuts(scored: DataFrame, slices: int) -> tuple[list[float], list[float]]:
    """Scores that cut the table into about equal slices, and those of them that alone fill a slice."""
    found = scored.agg(F.percentile_approx("score", [k / slices for k in range(1, slices)], 1000)).first()[0] or []
    return sorted(set(found)), sorted({c for c in found if found.count(c) > 1})


def id_cuts(rows: DataFrame, slices: int, key: str = "id", sample: int = 1000) -> list:
    """Keys that cut a table into about equal runs, from those of a sample with the least hashes."""
    found = sorted(r[0] for r in rows.where(F.col(key).isNotNull()).orderBy(F.xxhash64(key)).select(key).limit(sample).collect())
    return sorted({found[k * len(found) // slices] for k in range(1, slices)}) if found else []


def _sliced(scored: DataFrame, ascending: bool, slices: int) -> DataFrame:
    """Rows with the number `__slice` of a run of the sweep; a score that many rows share is cut further, by ids."""
    cuts, heavy = _cuts(scored, slices)
    below = F.size(F.filter(F.array(*[F.lit(float(c)) for c in cuts]).cast("array<double>"), lambda c: c < F.col("score")))
    tie = F.lit(0)
    if heavy:
        same = F.col("score").isin(*heavy)
        kind = scored.schema["id"].dataType
        ids = F.array(*[F.lit(i) for i in id_cuts(scored.where(same), slices)]).cast(f"array<{kind.simpleString()}>")
        # a heavy score is the last of its slice, and the first from above
        tie = F.when(same, F.size(F.filter(ids, lambda c: c < F.col("id"))) + (1 if ascending else 0)).otherwise(0 if ascending else slices)
    return scored.withColumn("__slice", (below if ascending else -below) * (slices + 1) + tie)


def swept(scored: DataFrame, groups: list[str], ascending: bool = True, slices: int = 32) -> DataFrame:
    """Rows with running class counts `cb`, `cs` and class totals `nb`, `ns` of their group, and their place `rn`.

    The score range is cut into slices: counts of earlier slices are added to sums within a slice, so that
    one big group, or one score that a large share of the rows has, is swept by many tasks.
    """
    rows = _sliced(scored, ascending, slices)
    counts = rows.groupBy(*groups, "__slice").agg(F.count_if("bona").alias("__nb"), F.count_if(~F.col("bona")).alias("__ns"))
    over = Window.partitionBy(*groups)
    earlier = over.orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        *[F.col(g).alias(f"__{g}") for g in groups], F.col("__slice").alias("__of"), F.coalesce(F.sum("__nb").over(earlier), F.lit(0)).alias("__before_b"),
        F.coalesce(F.sum("__ns").over(earlier), F.lit(0)).alias("__before_s"), F.sum("__nb").over(over).alias("nb"), F.sum("__ns").over(over).alias("ns"),
    )
    on = F.col("__slice").eqNullSafe(F.col("__of"))
    for g in groups:
        on = on & F.col(g).eqNullSafe(F.col(f"__{g}"))
    rows = rows.join(offsets, on)
    order = Window.partitionBy(*groups, "__slice").orderBy(F.asc("score") if ascending else F.desc("score"), "id").rowsBetween(Window.unboundedPreceding, 0)
    cb = F.sum(F.col("bona").cast("long")).over(order) + F.col("__before_b")
    cs = F.sum((~F.col("bona")).cast("long")).over(order) + F.col("__before_s")
    rows = rows.withColumn("cb", cb).withColumn("cs", cs).withColumn("rn", F.col("cb") + F.col("cs"))
    return rows.drop("__slice", "__of", "__before_b", "__before_s", *[f"__{g}" for g in groups])


def det_curve(scored: DataFrame, groups: list[str], **sweep) -> DataFrame:
    """Every row's false rejection and false acceptance rate if its score is the threshold."""
    rows = swept(scored, groups, **sweep)
    return rows.withColumn("frr", ratio(F.col("cb"), F.col("nb"))).withColumn("far", 1 - ratio(F.col("cs"), F.col("ns")))


def eer(scored: DataFrame, groups: list[str]) -> DataFrame:
    """Rate and threshold where the two rates are closest, the first such row; with class counts."""
    at = F.min_by(F.struct("frr", "far", "score"), F.struct(F.abs(F.col("frr") - F.col("far")), "rn")).alias("at")
    out = det_curve(scored, groups).groupBy(*groups).agg(F.max("nb").alias("n_bona"), F.max("ns").alias("n_spoof"), at)
    both = (F.col("n_bona") > 0) & (F.col("n_spoof") > 0)
    rate = F.when(both, (F.col("at.frr") + F.col("at.far")) / 2)
    return out.select(*groups, "n_bona", "n_spoof", rate.alias("eer"), F.when(both, F.col("at.score")).alias("threshold"))


def descending_eer(scored: DataFrame, groups: list[str]) -> DataFrame:
    """The sweep from high scores down: rate where misses and false alarms are closest, and the area by trapezoids."""
    rows = swept(scored, groups, ascending=False)
    rows = rows.withColumn("tpr", ratio(F.col("cb"), F.col("nb"))).withColumn("fpr", ratio(F.col("cs"), F.col("ns")))
    rows = rows.withColumn("fnr", 1 - F.col("tpr"))
    # a step right adds its height over 1/ns; a step up adds nothing: exact in counts
    step = F.when((~F.col("bona")) & (F.col("rn") > 1), 2 * F.col("cb")).otherwise(0)
    at = F.min_by(F.struct("fnr", "fpr"), F.struct(F.abs(F.col("fnr") - F.col("fpr")), "rn")).alias("at")
    out = rows.groupBy(*groups).agg(F.max("nb").alias("n_bona"), F.max("ns").alias("n_spoof"), at, F.sum(step).alias("twice"))
    both = (F.col("n_bona") > 0) & (F.col("n_spoof") > 0)
    area = F.when(both, F.col("twice").cast("double") / (2 * F.col("n_bona") * F.col("n_spoof")).cast("double"))
    return out.select(*groups, "n_bona", "n_spoof", F.when(both, (F.col("at.fnr") + F.col("at.fpr")) / 2).alias("eer"), area.alias("auc"))


def auc_ranksum(scored: DataFrame, groups: list[str]) -> DataFrame:
    """Rank-sum area from ordinal ranks; ties are not averaged."""
    out = swept(scored, groups).groupBy(*groups).agg(F.max("nb").alias("n_bona"), F.max("ns").alias("n_spoof"), F.sum(F.when(F.col("bona"), F.col("rn"))).alias("ranks"))
    wins = F.col("ranks") - F.col("n_bona") * (F.col("n_bona") + 1) / 2
    return out.select(*groups, "n_bona", "n_spoof", ratio(wins, F.col("n_bona") * F.col("n_spoof")).alias("auc"))


def confusion(scored: DataFrame, groups: list[str], threshold: Column) -> DataFrame:
    """tp, fp, tn, fn with the genuine class positive; a score at the threshold is accepted."""
    accepted, bona = F.col("score") >= threshold, F.col("bona")
    cells = {"tp": accepted & bona, "fp": accepted & ~bona, "tn": ~accepted & ~bona, "fn": ~accepted & bona}
    return scored.groupBy(*groups).agg(*[F.count_if(x).alias(n) for n, x in cells.items()])


def rates(counts: DataFrame) -> DataFrame:
    """Accuracy, and precision, recall and F1 of both classes, 0 where undefined."""
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    out = counts.withColumn("acc", zero_safe(tp + tn, tp + tn + fp + fn))
    for name, hit, wrong, missed in (("bona", tp, fp, fn), ("spoof", tn, fn, fp)):
        out = out.withColumn(f"{name}_precision", zero_safe(hit, hit + wrong)).withColumn(f"{name}_recall", zero_safe(hit, hit + missed))
        out = out.withColumn(f"{name}_f1", zero_safe(2 * hit, 2 * hit + wrong + missed))
    return out.withColumn("macro_f1", (F.col("bona_f1") + F.col("spoof_f1")) / 2)


def _agree(left: DataFrame, right: DataFrame, names: list[str]) -> tuple[DataFrame, Column]:
    """The right frame with the columns renamed, and the condition that they agree, nulls too."""
    on = F.lit(True)
    for c in names:
        right = right.withColumnRenamed(c, f"__of_{c}")
        on = on & F.col(c).eqNullSafe(F.col(f"__of_{c}"))
    return right, on


def _running(counts: DataFrame, groups: list[str]) -> DataFrame:
    """Of (groups..., __slice, __n): with the count of earlier slices `__before`, and of all, `__all`."""
    over = Window.partitionBy(*groups)
    earlier = over.orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("__before", F.coalesce(F.sum("__n").over(earlier), F.lit(0))).withColumn("__all", F.sum("__n").over(over)).drop("__n")


def pool_sweep(scored: DataFrame, system: str, pool: list[str], ascending: bool = True, slices: int = 32) -> DataFrame:
    """All rows in one order, each once: genuine ones with their count so far `cb`, others with that and the count `cs` of their system; totals `nb`, `ns`.

    Genuine rows serve every system of the same `pool` columns; no copy of them is made for a system.
    """
    rows = _sliced(scored.select(*pool, F.when(~F.col("bona"), F.col(system)).alias(system), "id", "score", "bona"), ascending, slices)
    own = [*pool, system]
    of_pool = _running(rows.groupBy(*pool, "__slice").agg(F.count_if("bona").alias("__n")), pool).withColumnsRenamed({"__before": "__before_b", "__all": "nb"})
    of_system = _running(rows.where("not bona").groupBy(*own, "__slice").agg(F.count("*").alias("__n")), own).withColumnsRenamed({"__before": "__before_s", "__all": "ns"})
    right, on = _agree(rows, of_pool, [*pool, "__slice"])
    swept_rows = rows.join(right, on).drop(*[f"__of_{c}" for c in [*pool, "__slice"]])
    right, on = _agree(swept_rows, of_system, [*own, "__slice"])
    swept_rows = swept_rows.join(right, on & ~F.col("bona"), "left").drop(*[f"__of_{c}" for c in [*own, "__slice"]])
    in_order = [F.asc("score") if ascending else F.desc("score"), F.asc("id")]
    upto = lambda by: Window.partitionBy(*by).orderBy(*in_order).rowsBetween(Window.unboundedPreceding, 0)
    cb = F.sum(F.col("bona").cast("long")).over(upto([*pool, "__slice"])) + F.col("__before_b")
    cs = F.sum((~F.col("bona")).cast("long")).over(upto([*pool, "__slice", system])) + F.col("__before_s")
    return swept_rows.withColumn("cb", cb).withColumn("cs", cs).select(*own, "score", "bona", "cb", "cs", "nb", "ns")


def system_eer(scored: DataFrame, system: str, pool: list[str] | None = None, ascending: bool = True) -> DataFrame:
    """(pool..., system, n_bona, n_spoof, eer, threshold, auc) of each system against the genuine rows that it shares with the others.

    As `eer` where `ascending`, else as `descending_eer`. The rates' difference rises with every row of a system's sweep, so it turns
    between two of the system's own rows, or at a genuine row between them, whose number follows from the counts.
    The area comes from the genuine rows ahead of each of the system's rows.
    """
    pool = pool or []
    rows = stored(pool_sweep(scored, system, pool, ascending), "sweep")
    exact = lambda c: F.col(c).cast("decimal(19,0)")
    turned = exact("cb") * exact("ns") + exact("cs") * exact("nb") >= exact("nb") * exact("ns")
    row, place = F.struct("cb", "cs", "score"), F.col("cb") + F.col("cs")
    found = rows.where("not bona").groupBy(*pool, system).agg(
        F.max("nb").alias("nb"), F.max("ns").alias("ns"), F.min_by(row, F.when(turned, place)).alias("after"),
        F.max_by(row, F.when(~turned, place)).alias("before"), F.sum("cb").alias("ahead"),
    )
    # genuine rows between the two: the first at which the rates have turned, and its neighbours
    done = F.coalesce("before.cs", F.lit(0)).cast("long")
    low, high = F.coalesce("before.cb", F.lit(0)).cast("long"), F.col("after.cb")
    first = F.ceil((exact("ns") - done.cast("decimal(19,0)")) * exact("nb") / F.nullif(exact("ns"), F.lit(0))).cast("long")
    ranks = F.array_distinct(F.filter(F.array(*[F.least(first + d, high) for d in (-1, 0, 1)]), lambda k: (k > low) & (k <= high)))
    found = stored(found.withColumn("done", done).withColumn("ranks", ranks), "sweep")
    genuine = found.select(*pool, F.explode("ranks").alias("cb")).distinct()
    right, on = _agree(rows, genuine, [*pool, "cb"])
    scores = rows.where("bona").join(right, on).select(*pool, "cb", "score")
    between = found.select(*pool, system, F.explode("ranks").alias("k"), F.col("done").alias("cs"))
    right, on = _agree(between, scores, pool)
    between = between.join(right, on & (F.col("k") == F.col("cb"))).select(*pool, system, F.struct(F.col("k").alias("cb"), "cs", "score").alias("at"))
    ends = found.select(*pool, system, F.explode(F.array("before", "after")).alias("at")).where("at is not null")
    right, on = _agree(found, ends.union(between), [*pool, system])
    every = found.join(right, on).withColumn("frr", ratio(F.col("at.cb"), F.col("nb"))).withColumn("far", 1 - ratio(F.col("at.cs"), F.col("ns")))
    if not ascending:
        # from above, what is counted are hits, not misses
        every = every.withColumn("frr", 1 - F.col("frr")).withColumn("far", 1 - F.col("far"))
    pick = F.min_by(F.struct("frr", "far", F.col("at.score").alias("score")), F.struct(F.abs(F.col("frr") - F.col("far")), F.col("at.cb") + F.col("at.cs"))).alias("x")
    best = every.groupBy(*pool, system).agg(F.max("nb").alias("n_bona"), F.max("ns").alias("n_spoof"), F.max("ahead").alias("ahead"), pick)
    both = (F.col("n_bona") > 0) & (F.col("n_spoof") > 0)
    wins = (F.col("n_bona") * F.col("n_spoof") - F.col("ahead")) if ascending else F.col("ahead")
    return best.select(
        *pool, system, "n_bona", "n_spoof", F.when(both, (F.col("x.frr") + F.col("x.far")) / 2).alias("eer"), F.when(both, F.col("x.score")).alias("threshold"),
        ratio(wins, F.col("n_bona") * F.col("n_spoof")).alias("auc"),
    )


def system_confusion(scored: DataFrame, system: str, thresholds: DataFrame) -> DataFrame:
    """(system, threshold, tp, fp, tn, fn) of each system in `thresholds` (system, threshold), with the genuine rows that all share.

    Genuine rows are counted between thresholds, once for all systems.
    """
    limits = F.broadcast(thresholds.agg(F.sort_array(F.collect_set("threshold")).alias("__limits")))
    above = F.size(F.filter("__limits", lambda t: t <= F.col("score"))).alias("__reached")
    genuine = scored.where("bona").crossJoin(limits).groupBy(above).agg(F.count("*").alias("__n"))
    # as many rows as there are thresholds, and one more
    counts = genuine.agg(F.collect_list(F.struct("__reached", "__n")).alias("__counts")).crossJoin(limits)
    right, on = _agree(scored, thresholds.select(system, "threshold"), [system])
    spoof = scored.where("not bona").join(F.broadcast(right), on)
    spoof = spoof.groupBy(system, "threshold").agg(F.count_if(F.col("score") >= F.col("threshold")).alias("fp"), F.count("*").alias("__m"))
    total = lambda keep: F.aggregate("__counts", F.lit(0).cast("long"), lambda s, c: s + F.when(keep(c), c["__n"]).otherwise(0))
    number = F.array_position("__limits", F.col("threshold"))
    out = spoof.crossJoin(F.broadcast(counts)).withColumn("__nr", number)
    return out.select(system, "threshold", total(lambda c: c["__reached"] >= F.col("__nr")).alias("tp"), "fp", (F.col("__m") - F.col("fp")).alias("tn"), total(lambda c: c["__reached"] < F.col("__nr")).alias("fn"))


def verdict(rate: Column) -> Column:
    return F.when(rate >= 0.40, "CLEAN").when(rate >= 0.25, "MILD").when(rate >= 0.10, "SERIOUS").otherwise("CRITICAL")
