"""Reports that put several measures of a corpus or a detector side by side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import det
from .selection import medians
from .stored import stored

POOLED = "pooled"


def by_system(scored: DataFrame, system: str = "system") -> DataFrame:
    """(system, n_bona, n_spoof, eer, mean_bona, mean_spoof, inverted) of all rows as `pooled`, and of each system against the shared genuine pool.

    `inverted` warns that genuine scores are not the higher ones on average.
    """
    bona = F.col("bona")
    mean = F.avg("score").alias("mean")
    genuine = scored.where(bona).agg(mean.alias("mean_bona"))
    spoof = scored.where(~bona).groupBy(system).agg(mean.alias("mean_spoof"))
    all_spoof = scored.where(~bona).agg(mean.alias("mean_spoof")).withColumn(system, F.lit(POOLED))
    rates = det.system_eer(scored, system).select(system, "n_bona", "n_spoof", "eer")
    rates = rates.unionByName(det.eer(scored, []).withColumn(system, F.lit(POOLED)).drop("threshold"))
    means = spoof.unionByName(all_spoof).withColumnRenamed(system, "__of").crossJoin(F.broadcast(genuine))
    out = rates.join(means, F.col(system).eqNullSafe(F.col("__of"))).drop("__of").select(system, "n_bona", "n_spoof", "eer", "mean_bona", "mean_spoof")
    return out.withColumn("inverted", ~F.coalesce(F.col("mean_bona") > F.col("mean_spoof"), F.lit(False)))


def calibrated(scored: DataFrame, test: str, threshold: DataFrame | None = None) -> DataFrame:
    """One row for each test (a system, against the genuine rows that all share): its rates at `threshold`, a one-row table, else at its own, which is labelled ORACLE.

    `mismatch` says that the threshold differs from the test's own by more than 1e-9; `own_threshold` is that.
    """
    given = det.system_eer(scored, test).select(test, "eer", F.col("threshold").alias("own_threshold"), "auc")
    given = stored(given, "calibrated")
    given = given.withColumn("threshold", F.col("own_threshold")) if threshold is None else given.crossJoin(F.broadcast(threshold.select("threshold")))
    counts = det.system_confusion(scored, test, given.select(test, "threshold")).withColumnRenamed(test, "__of").drop("threshold")
    out = det.rates(counts).join(given, F.col("__of").eqNullSafe(F.col(test))).drop("__of").withColumn("source", F.lit("ORACLE" if threshold is None else "calibrated"))
    return out.withColumn("mismatch", F.coalesce(F.abs(F.col("threshold") - F.col("own_threshold")) > 1e-9, F.lit(False)))


def against_model(rate: Column, model: Column) -> Column:
    """How a detector's rate stands against that of a probe that hears no speech; null where either is."""
    known = rate.isNotNull() & model.isNotNull()
    return F.when(known & (model >= rate), "no better").when(known & (rate - model < 0.05), "barely better").when(known, "clearly better")


def identity_checks(clips: DataFrame, ranks: DataFrame, gallery: int, noop: float, partial: bool = False) -> DataFrame:
    """(check, passed) of converted speech.

    `clips`: one row for each expected clip with `written`, `frames`, `ratio` of durations and `corr` with the input;
    `ranks`: `target_rank` and `source_rank` of each probe in a gallery of that many voices. Chance is the middle rank.
    `partial` spares the first check, for runs that were meant to be short.
    """
    written = F.coalesce(F.col("written"), F.lit(False))
    of_clips = clips.agg(
        F.count_if(~written).alias("missing"), F.count_if(written & (F.coalesce("frames", F.lit(0)) <= 0)).alias("empty"),
    )
    of_clips = of_clips.crossJoin(F.broadcast(medians(clips, ["ratio", "corr"])))
    of_ranks = medians(ranks.select(F.col("target_rank").alias("target"), F.col("source_rank").alias("source")), ["target", "source"])
    chance = (gallery + 1) / 2
    checks = {
        "every expected clip written": F.lit(partial) | (F.col("missing") == 0),
        "no empty clips": F.col("empty") == 0,
        "duration kept": F.col("ratio").between(0.8, 1.25),
        "not a pass-through": F.col("corr") < noop,
        "target ranks better than chance": F.col("target") < chance * 0.75,
        "target ranks above source": F.col("target") < F.col("source"),
    }
    rows = F.array(*[F.struct(F.lit(n).alias("check"), F.coalesce(c, F.lit(False)).alias("passed")) for n, c in checks.items()])
    return of_clips.crossJoin(F.broadcast(of_ranks)).select(F.inline(rows))


def split_report(rows: DataFrame, facets: list[str], split: str = "split", member: str = "speaker") -> DataFrame:
    """(split, facet, value, clips, members, percent): of each split as `all`, and of each value of each facet in it; percent is of the split's clips."""
    sets = rows.groupingSets([[split]] + [[split, f] for f in facets], split, *facets)
    out = sets.agg(F.grouping_id().alias("__g"), F.count("*").alias("clips"), F.countDistinct(member).alias("members"))
    # a set's own facet is the one whose bit is 0
    facet, value = F.lit("all"), F.lit(None).cast("string")
    for k, f in enumerate(facets):
        own = F.col("__g").bitwiseAND(1 << (len(facets) - 1 - k)) == 0
        facet, value = F.when(own, F.lit(f)).otherwise(facet), F.when(own, F.col(f).cast("string")).otherwise(value)
    out = out.select(split, facet.alias("facet"), value.alias("value"), "clips", "members")
    total = out.where("facet = 'all'").select(F.col(split).alias("__s"), F.col("clips").alias("__all"))
    joined = out.join(F.broadcast(total), F.col(split).eqNullSafe(F.col("__s")))
    return joined.select(split, "facet", "value", "clips", "members", F.round(F.lit(100.0) * F.col("clips") / F.col("__all"), 6).alias("percent"))


def describe_splits(rows: DataFrame, split: str = "split", member: str = "speaker") -> DataFrame:
    """(split, clips, bonafide, spoof, speakers, systems) of a manifest; `systems` are the spoofs' own, in order, `-` without any."""
    spoof = F.col("method") != "none"
    out = rows.groupBy(split).agg(
        F.count("*").alias("clips"), F.count_if(F.col("method") == "none").alias("bonafide"), F.count_if(spoof).alias("spoof"), F.countDistinct(member).alias("speakers"),
        F.array_join(F.sort_array(F.collect_set(F.when(spoof, F.col("method")))), ",").alias("systems"),
    )
    return out.withColumn("systems", F.when(F.col("systems") == "", "-").otherwise(F.col("systems")))


def level_change(rows: DataFrame, source: str, before: str, after: str) -> DataFrame:
    """(source, n, means and population deviations before and after, spread, ok): `spread` is the deviation of the sources' means after, ok below 0.5."""
    stats = [f(c).alias(f"{n}_{side}") for side, c in (("in", before), ("out", after)) for n, f in (("mean", F.avg), ("std", F.stddev_pop))]
    by = rows.groupBy(source).agg(F.count("*").alias("n"), *stats)
    spread = by.agg(F.stddev_pop("mean_out").alias("spread"))
    return by.crossJoin(F.broadcast(spread)).withColumn("ok", F.col("spread") < 0.5)


def inventory(rows: DataFrame, member: str, length: str, traits: list[str], formats: list[str]) -> DataFrame:
    """(measure, value, n) of an inventory: clips, members, total length, how many values each format column has, and members by trait.

    A member's trait is its smallest one that is not empty; members without one are not counted.
    """
    whole = rows.agg(F.count("*").alias("clips"), F.countDistinct(member).alias("members"), F.sum(length).cast("long").alias("length"), *[F.countDistinct(f).alias(f) for f in formats])
    names = ["clips", "members", "length", *formats]
    out = whole.select(F.inline(F.array(*[F.struct(F.lit(n).alias("measure"), F.lit("").alias("value"), F.col(n).cast("long").alias("n")) for n in names])))
    for t in traits:
        known = rows.where(F.trim(F.col(t).cast("string")) != "").groupBy(member).agg(F.min(F.col(t).cast("string")).alias("value"))
        out = out.unionByName(known.groupBy("value").agg(F.count("*").alias("n")).withColumn("measure", F.lit(t)))
    return out
