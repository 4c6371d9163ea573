"""Integrity constraints as queries: pairing, disjointness, leave-one-out invariants, drift, balance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .splits import ranked
from .stored import stored


def stem(column: str) -> Column:
    """A generated clip's id without its one-digit suffix."""
    return F.regexp_replace(F.col(column), r"\.\d$", "")


def _twins(bona: DataFrame) -> DataFrame:
    return bona.select("speaker", F.col("id").alias("stem"))


def paired(bona: DataFrame, spoof: DataFrame) -> DataFrame:
    """Spoofs whose stem is a genuine clip of the same speaker."""
    return spoof.join(_twins(bona), ["speaker", "stem"], "left_semi")


def unpaired(bona: DataFrame, spoof: DataFrame) -> DataFrame:
    return spoof.join(_twins(bona), ["speaker", "stem"], "left_anti")


def pairing_rate(bona: DataFrame, spoof: DataFrame, fatal: float = 0.05) -> DataFrame:
    """By method: spoofs, spoofs with a twin, the rate in percent, its verdict, and whether too many are lost (strictly)."""
    twins = _twins(bona).distinct().withColumn("__twin", F.lit(1))
    out = spoof.join(twins, ["speaker", "stem"], "left").groupBy("method").agg(F.count("*").alias("spoofs"), F.count("__twin").alias("twins"))
    rate = F.lit(100.0) * F.col("twins") / F.col("spoofs")
    verdict = F.when(rate >= 99.9, "PASS").when(rate >= 50, "WARN").otherwise("FAIL")
    return out.select("method", "spoofs", "twins", F.round(rate, 6).alias("rate"), verdict.alias("verdict"), ((F.col("spoofs") - F.col("twins")) / F.col("spoofs") > fatal).alias("fatal"))


def top_by_group(rows: DataFrame, group: str, member: str, k: int) -> DataFrame:
    """The k members with most rows of each group, with the group's total."""
    counts = rows.groupBy(group, member).agg(F.count("*").alias("lost"))
    place = F.row_number().over(Window.partitionBy(group).orderBy(F.desc("lost"), member)).cast("long")
    return counts.withColumn("place", place).withColumn("of_method", F.sum("lost").over(Window.partitionBy(group))).where(F.col("place") <= k)


def overlaps(rows: DataFrame, key: str, split: str) -> DataFrame:
    """(split_a, split_b, shared): pairs of rows of one key in two splits, none if the splits are disjoint."""
    sizes = rows.groupBy(key, split).agg(F.count("*").alias("n"))
    a, b = (sizes.select(key, F.col(split).alias(f"split_{x}"), F.col("n").alias(f"n_{x}")) for x in "ab")
    both = a.join(b, key).where("split_a < split_b")
    return both.groupBy("split_a", "split_b").agg(F.sum(F.col("n_a") * F.col("n_b")).alias("shared"))


def drift(rows: DataFrame, stratum: str, chosen: str, points: float) -> DataFrame:
    """Shares of each stratum among all and among the chosen, in percent, and whether they differ by more than `points`."""
    counts = rows.groupBy(stratum).agg(F.count("*").alias("members"), F.count_if(chosen).alias("chosen"))
    over = Window.partitionBy()
    a, b = (F.lit(100.0) * F.col(c) / F.sum(c).over(over) for c in ("members", "chosen"))
    return counts.select(stratum, "members", "chosen", F.round(a, 6).alias("share_all"), F.round(b, 6).alias("share_chosen"), (F.abs(a - b) > points).alias("drifts"))


def drifted(recorded: DataFrame, current: DataFrame, key: str, value: str) -> DataFrame:
    a, b = recorded.select(key, F.col(value).alias("recorded")), current.select(key, F.col(value).alias("current"))
    return a.join(b, key).where("recorded <> current")


def balance(disk: DataFrame, excluded: DataFrame, listed: DataFrame, key: str) -> DataFrame:
    """Whether what is on disk less what is excluded is what is listed, by key."""
    parts = [(disk, "on_disk"), (excluded, "excluded"), (listed, "listed")]
    long = None
    for frame, name in parts:
        one = frame.select(key, F.lit(name).alias("__kind"))
        long = one if long is None else long.unionByName(one)
    out = long.groupBy(key).agg(*[F.count_if(F.col("__kind") == n).alias(n) for _, n in parts])
    return out.withColumn("balanced", F.col("on_disk") - F.col("excluded") == F.col("listed"))


def _violations(*checks: tuple[str, DataFrame]) -> DataFrame:
    out = None
    for name, frame in checks:
        one = frame.agg(F.count("*").alias("violations")).select(F.lit(name).alias("check"), "violations")
        out = one if out is None else out.union(one)
    return out


def loso_checks(rows: DataFrame, held: str) -> DataFrame:
    """(check, violations) of a leave-one-system-out manifest; all 0 if it holds.

    Rows are read once: one aggregate groups them by speaker, clip, stem and split, and another adds up what each group says.
    """
    none, spoof, n = F.count_if(F.col("method") == "none"), F.count_if(F.col("method") != "none"), F.col("n")
    ways = ["speaker", "id", "stem", "split"]
    grouped = rows.groupingSets([[w] for w in ways], *ways).agg(
        F.grouping_id().alias("way"), F.count("*").alias("n"), none.alias("b"), spoof.alias("s"), (F.min("split") != F.max("split")).alias("apart"),
        F.count_if((F.col("split") != "test") & (F.col("method") == held)).alias("early"), F.count_if((F.col("split") == "test") & ~F.col("method").isin(held, "none")).alias("other"),
    )
    # a way's own bit is the only one that is 0
    by = {w: F.col("way") == 15 - (1 << (3 - k)) for k, w in enumerate(ways)}
    checks = {
        "speakers shared by splits": F.count_if(by["speaker"] & F.col("apart")),
        "held-out system in train or val": F.sum(F.when(by["split"], F.col("early"))),
        "other system in test": F.sum(F.when(by["split"], F.col("other"))),
        "split without both classes": F.count_if(by["split"] & ((F.col("b") == 0) | (F.col("s") == 0))),
        "spoof without twin": F.sum(F.when(by["stem"] & ((F.col("b") == 0) | F.col("stem").isNull()), F.col("s"))),
        "clip listed twice": F.count_if(by["id"] & (n > 1)),
    }
    found = grouped.agg(*[F.coalesce(c, F.lit(0)).alias(name) for name, c in checks.items()])
    return found.select(F.inline(F.array(*[F.struct(F.lit(name).alias("check"), F.col(f"`{name}`").alias("violations")) for name in checks])))


def paired_pool(bona: DataFrame, spoof: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(the genuine clips that are twins of spoofs, whoever speaks; stems without one, with how many spoofs each has)."""
    picked = bona.join(spoof.select(F.col("stem").alias("id")).distinct(), "id", "left_semi")
    return picked, spoof.join(bona.select(F.col("id").alias("stem")), "stem", "left_anti").groupBy("stem").agg(F.count("*").alias("spoofs"))


def preflight(rows: DataFrame, apart: tuple[str, str], splits: tuple[str, ...] = ("train", "val", "test")) -> DataFrame:
    """(check, status, n) before a run: spoofs of each split without twin in it, speakers of one split in another, and
    whether systems of two corpora that must stay `apart` are mixed.

    A split passes with at least 99.9 percent of its spoofs paired and warns from 50 percent on; a split without spoofs has no row.
    """
    genuine = rows.where("method = 'none'").select("split", F.col("id").alias("stem")).distinct().withColumn("__twin", F.lit(1))
    pairs = rows.where("method <> 'none'").join(genuine, ["split", "stem"], "left").groupBy("split").agg(F.count("*").alias("__n"), F.count("__twin").alias("__t"))
    rate = F.lit(100.0) * F.col("__t") / F.col("__n")
    status = F.when(rate >= 99.9, "PASS").when(rate >= 50, "WARN").otherwise("FAIL")
    pairing = pairs.select(F.concat(F.lit("pairing in "), F.col("split")).alias("check"), status.alias("status"), (F.col("__n") - F.col("__t")).alias("n"))
    in_split = rows.groupBy("speaker").agg(*[F.max(F.coalesce(F.col("split") == s, F.lit(False))).alias(s) for s in splits])
    shared = {f"speakers of {a} in {b}": F.count_if(F.col(a) & F.col(b)) for k, a in enumerate(splits) for b in splits[k + 1 :]}
    clash = rows.agg(*[F.count_if(F.col("method") == m).alias(f"__{k}") for k, m in enumerate(apart)]).select(F.lit(f"{apart[0]} mixed with {apart[1]}").alias("check"), F.least("__0", "__1").alias("n"))
    zero = in_split.agg(*[n.alias(c) for c, n in shared.items()]).select(F.inline(F.array(*[F.struct(F.lit(c).alias("check"), F.col(f"`{c}`").alias("n")) for c in shared]))).union(clash)
    return pairing.union(zero.select("check", F.when(F.col("n") == 0, "PASS").otherwise("FAIL"), "n"))


def loso_pair(rows: DataFrame, pool: DataFrame, held: str, known: str, seed: str) -> DataFrame:
    """One long manifest with `part`: train and val without the held-out system, and two tests of as many spoofs each,
    `matched` of the known system and `unseen` of the held-out one, against one pool of the genuine twins of both. Each frame is made once and written."""
    rows, pool = stored(rows, "spoofs"), stored(pool, "pool")
    fit = rows.where((F.col("split") != "test") & (F.col("method") != held))
    fit = fit.unionByName(pool.join(fit.select("stem").distinct(), "stem", "left_semi").select(*fit.columns)).withColumn("part", F.col("split"))
    trimmed, twins = test_pair(rows.where("split = 'test'"), pool.where("split = 'test'"), [known, held], seed)
    tests = trimmed.withColumn("part", F.when(F.col("method") == held, "unseen").otherwise("matched"))
    genuine = pool.join(twins, "id", "left_semi").select(*rows.columns)
    both = genuine.withColumn("part", F.explode(F.array(F.lit("matched"), F.lit("unseen"))))
    return fit.unionByName(tests.select(*fit.columns)).unionByName(both.select(*fit.columns))


def loso_pair_checks(rows: DataFrame, held: str) -> DataFrame:
    """(check, violations) of such a pair; all 0 if it holds. Rows are read once, and grouped by speaker and by clip in one aggregate."""
    spoof, parts = F.col("method") != "none", ("train", "val", "matched", "unseen")
    of = lambda p, x=F.lit(True): F.count_if((F.col("part") == p) & x)
    counts = [c for p in parts for c in (of(p).alias(f"n_{p}"), of(p, spoof).alias(f"s_{p}"), of(p, ~spoof).alias(f"b_{p}"))]
    grouped = rows.groupingSets([["speaker"], ["id"]], "speaker", "id").agg(
        F.grouping_id().alias("way"), *counts, F.count_if((F.col("method") == held) & (F.col("part") != "unseen")).alias("outside"), of("unseen", spoof & (F.col("method") != held)).alias("other"),
    )
    # a way's own bit is the only one that is 0; the groups of either way add up to all rows
    speaker, clip, has = F.col("way") == 1, F.col("way") == 2, lambda c: F.col(c) > 0
    total = lambda c: F.coalesce(F.sum(F.when(clip, F.col(c))), F.lit(0))
    checks = {f"speakers of {a} in {b}": F.count_if(speaker & has(f"n_{a}") & has(f"n_{b}")) for a, b in (("train", "val"), ("train", "matched"), ("train", "unseen"), ("val", "matched"), ("val", "unseen"))}
    checks |= {
        "spoof in both tests": F.count_if(clip & has("s_matched") & has("s_unseen")),
        "genuine clip in one test only": F.count_if(clip & (has("b_matched") != has("b_unseen"))),
        "held-out system outside its test": total("outside"),
        "other system in the unseen test": total("other"),
        "part without both classes": sum(((total(f"s_{p}") == 0) | (total(f"b_{p}") == 0)).cast("long") for p in parts),
        "spoofs of one test more than of the other": F.abs(total("s_matched") - total("s_unseen")),
    }
    found = grouped.agg(*[c.cast("long").alias(name) for name, c in checks.items()])
    return found.select(F.inline(F.array(*[F.struct(F.lit(name).alias("check"), F.col(f"`{name}`").alias("violations")) for name in checks])))


def pair_checks(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """(check, violations) of a source-target map."""
    split_of = members.select(F.col("member").alias("target"), F.col("split").alias("__other"))
    return _violations(
        ("fixed point", pairs.where("source = target")),
        ("repeated target", pairs.groupBy("target").count().where("count > 1")),
        ("repeated source", pairs.groupBy("source").count().where("count > 1")),
        ("target of another split", pairs.join(split_of, "target").where("split <> __other")),
        ("member without pair", members.join(pairs.select(F.col("source").alias("member")), "member", "left_anti")),
        ("unknown target", pairs.join(split_of, "target", "left_anti")),
    )


def test_pair(spoofs: DataFrame, pool: DataFrame, systems: list[str], seed: str) -> tuple[DataFrame, DataFrame]:
    """Both systems' spoofs trimmed to the smaller side, and the genuine twins of all of them, once each. Spoofs are made once and written, and so are the trimmed ones."""
    sides = stored(spoofs.where(F.col("method").isin(systems)), "sides")
    least = sides.groupBy("method").agg(F.count("*").alias("__m")).agg(F.min("__m").alias("__least"))
    trimmed = ranked(sides, ["method"], seed, "id").crossJoin(F.broadcast(least)).where("__rn <= __least").select(*spoofs.columns)
    trimmed = stored(trimmed, "trimmed")
    return trimmed, pool.join(trimmed.select("stem").distinct(), "stem", "left_semi").select("id").distinct()
