"""Bootstrap tables drawn from hashes: the same draw in any engine, and for every model.

Draw (b, slot) picks member md5(seed-b-slot) mod n of an ordered list. A replicate repeats the rows of what it
drew as often as it drew it, so the sweep over its rows stays exact.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .det import id_cuts
from .stored import stored


def hash_number(*parts: Column | str | int) -> Column:
    """The first 32 bits of the md5 of the parts joined by '-'."""
    texts = [p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.conv(F.substring(F.md5(F.concat_ws("-", *texts).cast("binary")), 1, 8), 16, 10).cast("long")


def numbered(frame: DataFrame, strata: list[str], key: str, slices: int = 32) -> DataFrame:
    """Members numbered from 0 within strata, in order of the key, as `k`.

    The key's range is cut into runs: a number is the place in its run after the counts of earlier ones, so many tasks number one stratum.
    """
    cuts = F.array(*[F.lit(c) for c in id_cuts(frame, slices, key)]).cast(f"array<{frame.schema[key].dataType.simpleString()}>")
    rows = frame.withColumn("__run", F.size(F.filter(cuts, lambda c: c < F.col(key))))
    counts = rows.groupBy(*[F.col(s).alias(f"__in_{s}") for s in strata], F.col("__run").alias("__of")).agg(F.count("*").alias("__m"))
    earlier = Window.partitionBy(*[f"__in_{s}" for s in strata]).orderBy("__of").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("__before", F.coalesce(F.sum("__m").over(earlier), F.lit(0))).drop("__m")
    on = F.col("__run") == F.col("__of")
    for s in strata:
        on = on & F.col(s).eqNullSafe(F.col(f"__in_{s}"))
    place = F.row_number().over(Window.partitionBy(*strata, "__run").orderBy(key)) - 1 + F.col("__before")
    return rows.join(counts, on).withColumn("k", place.cast("long")).select(*frame.columns, "k")


#: Rows of a slice of a sweep, at most slices, slots that a task draws at once, and replicates that are counted together.
SLICE_ROWS, MOST_SLICES, SLOTS, TOGETHER = 1 << 16, 1024, 1 << 20, 64
#: Pairs of member and slice that a block of members is to hold.
BLOCK_PAIRS = 1 << 18
#: Bytes of packed draws that a task holds before it sends them on.
HELD = 8 << 20


def _blob(array: np.ndarray) -> bytes:
    return zlib.compress(np.ascontiguousarray(array).tobytes(), 1)


def _array(blob: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zlib.decompress(blob), dtype=kind)


def _placed(rows: DataFrame, models: list[str]) -> DataFrame:
    """(model, slice, place, stratum, k, bona): rows of each model in order of score and id, nulls first, in slices that hold a bounded number of rows each.

    Slices are ranges of (score, id), so that a score which many rows share is cut too.
    """
    spark, n = rows.sparkSession, rows.count()
    slices = min(MOST_SLICES, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // SLICE_ROWS)))
    out = None
    for i, m in enumerate(models):
        by = [F.col("score"), F.col("tie")]
        one = rows.select("stratum", "k", "bona", F.col(m).alias("score"), F.concat(F.col("id").cast("string"), F.lit("-")).alias("tie"))
        one = one.repartitionByRange(slices, *by).sortWithinPartitions(*by).withColumn("at", F.monotonically_increasing_id())
        one = one.select(F.lit(i).alias("model"), F.shiftright("at", 33).cast("int").alias("slice"), F.col("at").bitwiseAND((1 << 33) - 1).alias("place"), "stratum", "k", "bona")
        out = one if out is None else out.union(one)
    return stored(out, "bootstrap")


def _drawer(seed: str, block: int):
    """Draws the slots of (stratum, n, b, chunk) rows; packed members of blocks leave in batches of some `HELD` bytes."""

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, slots = None, []

        def packed(out: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*out)) or [()] * 5
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["stratum", "block", "b", "group", "drawn"])

        for batch in batches:
            out, held = [], 0
            for stratum, n, b, chunk in zip(*(batch.column(c).to_pylist() for c in ("stratum", "n", "b", "chunk"))):
                if last != (n, chunk):
                    last, slots = (n, chunk), [b"%d" % slot for slot in range(chunk * SLOTS, min(n, (chunk + 1) * SLOTS))]
                head, digests = hashlib.md5(f"{seed}-{stratum}-{b}-".encode(), usedforsecurity=False), []
                for slot in slots:
                    one = head.copy()
                    one.update(slot)
                    digests.append(one.digest())
                # the first 32 bits of each
                k = np.sort(np.frombuffer(b"".join(digests), dtype=">u4")[::4].astype(np.int64) % n)
                cuts = np.flatnonzero(np.diff(k // block)) + 1
                for own in np.split(k, cuts):
                    out.append((stratum, int(own[0] // block), b, b // TOGETHER, _blob((own % block).astype("<u4"))))
                    held += len(out[-1][-1])
                # a batch of replicates would be held whole else, and grows with the members
                if held >= HELD:
                    yield packed(out)
                    out, held = [], 0
            yield packed(out)

    return draw


def _draws_by_block(spark: SparkSession, sizes: dict[str, int], n_boot: int, seed: str, block: int) -> DataFrame:
    """(stratum, block, b, group, drawn): which members of a block a replicate draws, one packed row from each range of slots."""
    grid = None
    for stratum, n in sizes.items():
        i = F.col("id")
        one = spark.range(n_boot * -(-n // SLOTS)).select(F.lit(stratum).alias("stratum"), F.lit(n).cast("long").alias("n"), (i % n_boot).alias("b"), F.floor(i / n_boot).cast("long").alias("chunk"))
        grid = one if grid is None else grid.union(one)

    return grid.mapInArrow(_drawer(seed, block), "stratum string, block long, b long, group long, drawn binary")


def _counted(draws: DataFrame, pairs: DataFrame, n_models: int, n_slices: int, block: int, n_groups: int) -> DataFrame:
    """(stratum, block, b, times, sums): how often each member of a block is drawn, and rows drawn by model, slice and class."""

    def directory(table: pa.Table) -> pa.Table:
        arrays = [table.column(c).to_numpy() for c in ("cell", "local", "nb", "ns")]
        blobs = [pa.array([_blob(a.astype("<i8"))], pa.binary()) for a in arrays]
        return pa.table([table.column("stratum")[:1], table.column("block")[:1], *blobs], names=["stratum", "block", "cells", "locals", "bonas", "spoofs"])

    cell = (F.col("model") * n_slices + F.col("slice")).cast("long").alias("cell")
    packed = pairs.select("stratum", "block", cell, "local", "nb", "ns").groupBy("stratum", "block")
    packed = packed.applyInArrow(directory, "stratum string, block long, cells binary, locals binary, bonas binary, spoofs binary")
    packed = packed.withColumn("group", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_groups - 1).cast("long"))))

    def count(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if len(left) and len(right):
            cells, locals_, bonas, spoofs = (_array(right.column(c)[0].as_py(), "<i8") for c in ("cells", "locals", "bonas", "spoofs"))
            stratum, of = left.column("stratum")[0].as_py(), left.column("block")[0].as_py()
            by: dict[int, np.ndarray] = {}
            for b, drawn in zip(left.column("b").to_pylist(), left.column("drawn").to_pylist()):
                by[b] = by.get(b, 0) + np.bincount(_array(drawn, "<u4"), minlength=block)
            for b, times in by.items():
                sums = [np.bincount(cells, weights=times[locals_] * x, minlength=n_models * n_slices).astype("<i8") for x in (bonas, spoofs)]
                last = int(np.flatnonzero(times)[-1]) + 1
                out.append((stratum, of, b, _blob(times[:last].astype("<u4")), _blob(np.concatenate(sums))))
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
        return pa.table([pa.array(c, t) for c, t in zip(list(zip(*out)) or [()] * 5, kinds)], names=["stratum", "block", "b", "times", "sums"])

    # packed rows are small for the work in them, so partitions are not to be merged by their size
    key, parts = ["stratum", "block", "group"], int(draws.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = draws.repartition(parts, *key).groupBy(*key).cogroup(packed.repartition(parts, *key).groupBy(*key))
    return stored(both.applyInArrow(count, "stratum string, block long, b long, times binary, sums binary"), "bootstrap")


def _crossings(counted: DataFrame, n_models: int, n_slices: int) -> DataFrame:
    """(b, model, slice, cb, cs, nb, ns): the slice of each sweep in which the rates meet, and counts before it; none where a class is missing.

    The difference of the rates rises with every row, so the last row before it turns and the first one after are in that
    slice, or the former ends the slices before.
    """

    def cross(table: pa.Table) -> pa.Table:
        bona, spoof = sum(_array(x, "<i8") for x in table.column("sums").to_pylist()).reshape(2, n_models, n_slices)
        b, out = table.column("b")[0].as_py(), []
        for m in range(n_models):
            cb, cs = np.cumsum(bona[m]), np.cumsum(spoof[m])
            nb, ns = int(cb[-1]), int(cs[-1])
            if nb and ns:
                at = int(np.argmax(cb / nb - (1 - cs / ns) >= 0))
                out.append((b, m, at, int(cb[at] - bona[m][at]), int(cs[at] - spoof[m][at]), nb, ns))
            elif nb or ns:
                out.append((b, m, None, 0, 0, nb, ns))
        kinds = (pa.int64(), pa.int32(), pa.int32(), *[pa.int64()] * 4)
        return pa.table([pa.array(c, t) for c, t in zip(list(zip(*out)) or [()] * 7, kinds)], names=["b", "model", "slice", "cb", "cs", "nb", "ns"])

    found = counted.select("b", "sums").groupBy("b").applyInArrow(cross, "b long, model int, slice int, cb long, cs long, nb long, ns long")
    return stored(found, "bootstrap")


def _searched(crossings: DataFrame, counted: DataFrame, placed: DataFrame, pairs: DataFrame) -> DataFrame:
    """(b, model, eer) by a search of one slice for each replicate and model."""
    # one row for each replicate and model at most
    at = F.broadcast(crossings.where("slice is not null").select("model", "slice").distinct())
    members = pairs.join(at, ["model", "slice"], "left_semi").groupBy("model", "slice", "stratum", "block").agg(F.sort_array(F.collect_set("local")).alias("locals"))
    wanted = crossings.where("slice is not null").select("b", "model", "slice").join(members, ["model", "slice"])

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for blob, locals_ in zip(batch.column("times").to_pylist(), batch.column("locals")):
                times, own = _array(blob, "<u4"), locals_.values.to_numpy()
                found.append(_blob(np.where(own < len(times), times[np.minimum(own, len(times) - 1)], 0).astype("<u4")))
            names = ["b", "model", "slice", "stratum", "block"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(found, pa.binary())], names=[*names, "times"])

    held = wanted.join(counted.select("stratum", "block", "b", "times"), ["stratum", "block", "b"])
    held = held.mapInArrow(look, "b long, model int, slice int, stratum string, block long, times binary")
    held = held.join(crossings.select("b", "model", "cb", "cs", "nb", "ns"), ["b", "model"]).withColumn("group", F.floor(F.col("b") / TOGETHER).cast("long"))
    groups = F.broadcast(crossings.where("slice is not null").select("model", "slice", F.floor(F.col("b") / TOGETHER).cast("long").alias("group")).distinct())
    rows = placed.join(groups, ["model", "slice"])

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = right.select(["stratum", "block", "local", "bona", "place"]).to_pandas().sort_values("place", ignore_index=True)
        bona = rows["bona"].to_numpy(bool)
        # where the rows of a stratum's block stand, and which of its members in this slice each one is
        where = {key: (own.to_numpy(), np.unique(rows["local"].to_numpy()[own], return_inverse=True)[1]) for key, own in rows.groupby(["stratum", "block"]).groups.items()}
        found = left.to_pandas()
        out = []
        for (b, model), parts in found.groupby(["b", "model"]):
            times = np.zeros(len(rows), dtype=np.int64)
            for stratum, of, blob in zip(parts["stratum"], parts["block"], parts["times"]):
                own, member = where[stratum, of]
                times[own] = _array(blob, "<u4")[member]
            cb, cs, nb, ns = (int(parts[c].iloc[0]) for c in ("cb", "cs", "nb", "ns"))
            drawn = np.repeat(bona, times)
            frr, far = (cb + np.cumsum(drawn)) / nb, 1 - (cs + np.cumsum(~drawn)) / ns
            if cb + cs:
                frr, far = np.concatenate([[cb / nb], frr]), np.concatenate([[1 - cs / ns], far])
            k = int(np.argmin(np.abs(frr - far)))
            out.append((b, model, float((frr[k] + far[k]) / 2)))
        return pa.table([pa.array(c, t) for c, t in zip(list(zip(*out)) or [()] * 3, (pa.int64(), pa.int32(), pa.float64()))], names=["b", "model", "eer"])

    key = ["model", "slice", "group"]
    parts = int(held.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return held.repartition(parts, *key).groupBy(*key).cogroup(rows.repartition(parts, *key).groupBy(*key)).applyInArrow(search, "b long, model int, eer double")


def replicates(rows: DataFrame, members: DataFrame, models: list[str], n_boot: int, seed: str) -> DataFrame:
    """(b, model, eer) of rows that are drawn as often as their member is.

    `rows` has `id`, `bona`, `stratum`, the member's number `k` in it and a score column for each model; `members` has (stratum, n). Nothing
    but sizes comes to the driver. Tasks draw ranges of slots and send packed members to blocks; a block counts how
    often each of its members is drawn and what that adds to each slice of the sorted rows. The slices' sums give every
    slice its counts before, so only the slice in which the rates meet is searched row by row. What is shuffled and
    stored follows draws: some four bytes for each row and replicate, half of it before packing.
    """
    spark = rows.sparkSession
    sizes = {r["stratum"]: r["n"] for r in members.collect()}
    placed = _placed(rows, models)
    # rows of one member in one slice count together: a member of very many rows is one pair in each slice at most
    pairs = placed.groupBy("stratum", "k", "model", "slice").agg(F.count_if("bona").alias("nb"), F.count_if(~F.col("bona")).alias("ns"))
    pairs = stored(pairs, "bootstrap")
    n_pairs, top = pairs.agg(F.count("*"), F.max("slice")).first()
    if not n_pairs:
        return spark.createDataFrame([], "b long, model string, eer double")
    block = max(1, BLOCK_PAIRS * sum(sizes.values()) // n_pairs)
    number, local = F.floor(F.col("k") / block).cast("long").alias("block"), (F.col("k") % block).cast("long").alias("local")
    pairs, placed = pairs.select("*", number, local), placed.select("*", number, local)
    draws = _draws_by_block(spark, sizes, n_boot, seed, block)
    counted = _counted(draws, pairs, len(models), top + 1, block, -(-n_boot // TOGETHER))
    crossings = _crossings(counted, len(models), top + 1)
    found = _searched(crossings, counted, placed, pairs)
    none = crossings.where("slice is null").select("b", "model", F.lit(None).cast("double").alias("eer"))
    name = F.element_at(F.array(*[F.lit(m) for m in models]), F.col("model") + 1)
    return found.union(none).select("b", name.alias("model"), "eer")


def class_bootstrap(scored: DataFrame, n_boot: int, seed: str = "boot") -> DataFrame:
    """(b, eer) of replicates that redraw each class; null where there is only one, no rows where there are none."""
    rows = stored(numbered(scored.select("id", "score", "bona"), ["bona"], "id").withColumn("stratum", F.col("bona").cast("string")), "bootstrap")
    sizes = rows.groupBy("stratum").agg(F.count("*").alias("n"))
    return replicates(rows, sizes, ["score"], n_boot, seed).drop("model")


def cluster_bootstrap(scored: DataFrame, cluster: str, models: list[str], n_boot: int, seed: str = "cluster") -> DataFrame:
    """(b, model, eer) of replicates that redraw clusters with all their rows, one draw for all models.

    `scored` has `id`, `bona`, the cluster and one score column for each model. A replicate of one class is null, one without rows
    is left out. Rows without a cluster are never drawn, though they count as one.
    """
    members = stored(numbered(scored.select(F.col(cluster).alias("c")).distinct().withColumn("stratum", F.lit("1")), ["stratum"], "c"), "bootstrap")
    scores = [F.col(m).alias(f"m{i}") for i, m in enumerate(models)]
    rows = stored(scored.select("id", "bona", F.col(cluster).alias("c"), *scores).join(members, "c").drop("c"), "bootstrap")
    out = replicates(rows, members.groupBy("stratum").agg(F.count("*").alias("n")), [f"m{i}" for i in range(len(models))], n_boot, seed)
    names = F.create_map(*[x for i, m in enumerate(models) for x in (F.lit(f"m{i}"), F.lit(m))])
    return out.withColumn("model", names[F.col("model")])


def interval(replicates: DataFrame, groups: list[str], value: str = "eer") -> DataFrame:
    """Bounds of the middle 95 percent, by linear interpolation, with how many replicates there are."""
    cut = lambda p: F.percentile(value, F.lit(p))
    return replicates.groupBy(*groups).agg(F.count("*").alias("n_boot"), cut(0.025).alias("low"), cut(0.975).alias("high"))


def paired_difference(replicates: DataFrame, a: str, b: str) -> DataFrame:
    """One row: interval of eer(a) - eer(b) by replicate, the share above 0 of all replicates, and whether 0 is outside."""
    one, two = (replicates.where(F.col("model") == m).select("b", F.col("eer").alias(n)) for m, n in ((a, "ea"), (b, "eb")))
    d = one.join(two, "b").withColumn("d", F.col("ea") - F.col("eb"))
    out = d.agg(
        F.count("*").alias("n_boot"), F.percentile("d", F.lit(0.025)).alias("low"), F.percentile("d", F.lit(0.975)).alias("high"),
        (F.count_if(F.col("d") > 0) / F.count("*")).alias("share_positive"),
    )
    return out.withColumn("excludes_zero", F.coalesce((F.col("low") > 0) | (F.col("high") < 0), F.lit(False)))
