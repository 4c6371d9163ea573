"""Vector operators: centroids, centring, cosine ranks and pairwise medians; vectors are arrays of doubles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import selection
from .stored import stored


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    """v by its length; the zero vector stays."""
    # the length is worked out once, as the only element of an outer array, not for each element of v
    by = lambda n: F.transform(v, lambda x: F.when(n > 0, x / n).otherwise(x))
    return F.element_at(F.transform(F.array(F.sqrt(dot(v, v))), by), 1)


def mean_vector(frame: DataFrame, groups: list[str], vector: str) -> DataFrame:
    """(groups..., mean): one average for each dimension, in one aggregate; vectors that are null or empty don't count."""
    known = frame.where(F.size(vector) > 0)
    n = known.agg(F.max(F.size(vector))).first()[0] or 0
    means = known.groupBy(*groups).agg(*[F.avg(F.get(vector, F.lit(d))).alias(f"__{d}") for d in range(n)], F.count("*").alias("__n"))
    return means.select(*groups, F.array(*[F.col(f"__{d}") for d in range(n)]).cast("array<double>").alias("mean"))


def voice_centroids(frame: DataFrame, groups: list[str], vector: str = "mfcc") -> DataFrame:
    """(groups..., centroid): the mean of a voice's clips at length 1; clips without a vector are left out."""
    means = mean_vector(frame.where(F.col(vector).isNotNull()), groups, vector)
    return means.select(*groups, unit(F.col("mean")).alias("centroid"))


def _packed(rows: DataFrame, arrays: list[str], matrices: list[str], by: list[str]) -> DataFrame:
    """One row for each block `by`: a column's values as an array, in order of the column `nr`, and vectors as the bytes of one matrix."""

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by("nr")
        out = {c: table.column(c)[:1] for c in by} | {"n": pa.array([len(table)])}
        for c in arrays:
            out[c] = pa.array([table.column(c).to_pylist()], pa.list_(table.schema.field(c).type))
        for c in matrices:
            out[c] = pa.array([_matrix(table.column(c)).tobytes()], pa.binary())
        return pa.table(out)

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    body = [f"`{c}` {kinds[c]}" for c in by] + ["n long"] + [f"`{c}` array<{kinds[c]}>" for c in arrays] + [f"`{c}` binary" for c in matrices]
    return rows.groupBy(*by).applyInArrow(pack, ", ".join(body))


def _matrix(vectors: pa.ChunkedArray) -> np.ndarray:
    flat = vectors.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(vectors), -1)


def _rows_of(blob: bytes, n: int) -> np.ndarray:
    return np.frombuffer(blob, dtype=np.float64).reshape(n, -1)


def _dealt(frame: DataFrame, n: int, tile: int) -> tuple[DataFrame, int]:
    """Rows dealt evenly into blocks of about `tile`, and how many blocks there are; hot keys play no part."""
    blocks = max(1, -(-n // tile))
    numbered = frame.withColumn("nr", F.monotonically_increasing_id())
    return numbered.withColumn("block", F.pmod(F.xxhash64("nr"), F.lit(blocks)).cast("long")), blocks


def _upto(n: int) -> Column:
    return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))


def own_ranks(probes: DataFrame, gallery: DataFrame, tile: int = 2048) -> DataFrame:
    """(probe, own, rank): where each probe's own member ranks: one more than the members above it, ties by name; similarities to 9 decimals.

    Probes and gallery may be of any size: blocks of one meet blocks of the other as products of matrices, one pair of blocks at a
    time in a task, and only the counts of members above leave it. A probe whose own member is not in the gallery is left out.
    """
    members = stored(gallery.select(F.col("label").alias("member"), F.col("vector").alias("__g")), "gallery")
    rows = probes.select("probe", "own", "vector").join(members, F.col("own") == F.col("member")).select("probe", "own", "vector", "__g")
    rows = stored(rows, "probes")
    dealt, n_blocks = _dealt(rows, rows.count(), tile)
    tiles, n_tiles = _dealt(members, members.count(), tile)
    left = stored(_packed(dealt, ["nr", "probe", "own"], ["vector", "__g"], ["block"]), "probes")
    right = stored(_packed(tiles.withColumnRenamed("block", "tile"), ["member"], ["__g"], ["tile"]), "gallery")
    right = right.select("tile", F.col("n").alias("m"), "member", F.col("__g").alias("other"), _upto(n_blocks).alias("of"))
    pairs = left.withColumn("at", _upto(n_tiles)).join(right, (F.col("block") == F.col("of")) & (F.col("at") == F.col("tile")))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                r = {c: batch.column(c)[k] for c in ("n", "m", "vector", "__g", "other")}
                names, own = batch.column("member")[k].as_py(), batch.column("own")[k].as_py()
                x, g = (_rows_of(r[c].as_py(), r["n"].as_py()) for c in ("vector", "__g"))
                sims = np.round(x @ _rows_of(r["other"].as_py(), r["m"].as_py()).T, 9)
                mine = np.round(np.einsum("ij,ij->i", x, g), 9)[:, None]
                place = {m: j for j, m in enumerate(names)}
                for i, o in enumerate(own):
                    if o in place:
                        sims[i, place[o]] = -np.inf
                above = (sims > mine).sum(axis=1)
                for i, j in zip(*np.nonzero(sims == mine)):
                    above[i] += names[j] < own[i]
                out = [batch.column(c)[k].values for c in ("nr", "probe", "own")]
                yield pa.RecordBatch.from_arrays([*out, pa.array(above.astype(np.int64))], names=["nr", "probe", "own", "above"])

    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("probe", "own")}
    counts = pairs.select("n", "m", "nr", "probe", "own", "vector", "__g", "member", "other").mapInArrow(count, f"nr long, probe {kinds['probe']}, own {kinds['own']}, above long")
    return counts.groupBy("nr", "probe", "own").agg((F.sum("above") + 1).alias("rank")).drop("nr")


def median_pairwise(frame: DataFrame, group: str, key: str, vector: str, tile: int = 1024) -> DataFrame:
    """(group, pairs, median) of the cosines of all pairs of different keys within a group of any size; cosines to 12 decimals.

    Pairs are never listed: a group's blocks meet each other as products of matrices, in tasks that count the cosines' keys, and the
    median is found by refining those counts. A group without pairs is left out.
    """
    base = frame.select(F.col(group).alias("g"), F.col(key).alias("k"), F.col(vector).alias("v")).where("k is not null and v is not null")
    base = stored(base.withColumn("nr", F.monotonically_increasing_id()), "pairwise")
    sizes = base.groupBy(F.col("g").alias("of")).agg(F.ceil(F.count("*") / tile).cast("long").alias("blocks"))
    rows = base.join(sizes, F.col("g").eqNullSafe(F.col("of"))).drop("of").withColumn("block", F.pmod(F.xxhash64("nr"), F.col("blocks")))
    packed = stored(_packed(rows, ["k"], ["v"], ["g", "block", "blocks"]), "pairwise")
    left = packed.withColumn("with", F.explode(F.sequence("block", F.col("blocks") - 1)))
    right = packed.select(F.col("g").alias("h"), F.col("block").alias("other"), F.col("n").alias("m"), F.col("k").alias("l"), F.col("v").alias("w"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("block"))).alias("from"))
    pairs = left.join(right, F.col("g").eqNullSafe(F.col("h")) & (F.col("block") == F.col("from")) & (F.col("with") == F.col("other"))).select("g", "block", "other", "n", "m", "k", "l", "v", "w")
    kind = frame.schema[group].dataType.simpleString()

    def wanted_pairs(batch: pa.RecordBatch, i: int) -> np.ndarray:
        a, b = batch.column("k")[i].values, batch.column("l")[i].values
        codes = pa.chunked_array([a, b]).dictionary_encode().combine_chunks().indices.to_numpy()
        mask = codes[: len(a), None] != codes[None, len(a) :]
        return np.triu(mask, 1) if batch.column("block")[i].as_py() == batch.column("other")[i].as_py() else mask

    def sized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = [int(wanted_pairs(batch, i).sum()) for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column("g"), pa.array(n, pa.int64())], names=["g", "n"])

    def counter(shift: int):
        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                buckets, counts = [], []
                for i in range(batch.num_rows):
                    n, m = batch.column("n")[i].as_py(), batch.column("m")[i].as_py()
                    cosines = np.round(_rows_of(batch.column("v")[i].as_py(), n) @ _rows_of(batch.column("w")[i].as_py(), m).T, 12)[wanted_pairs(batch, i)]
                    keys = selection.keys_of(cosines)
                    if shift != selection.SHIFTS[0]:
                        keys = keys[keys >> (shift + 16) == batch.column("__prefix")[i].as_py()]
                    found, times = np.unique(keys >> shift, return_counts=True)
                    buckets.append(found)
                    counts.append(times)
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("g", "__prefix", "__ranks")), pa.array(buckets, pa.list_(pa.int64())), pa.array(counts, pa.list_(pa.int64()))], names=["g", "__prefix", "__ranks", "buckets", "counts"])

        return count

    def counted(wanted: DataFrame, shift: int) -> DataFrame:
        ranks = wanted.schema["__ranks"].dataType.simpleString()
        held = pairs.join(wanted.withColumnRenamed("g", "of"), F.col("g").eqNullSafe(F.col("of"))).drop("of")
        found = held.mapInArrow(counter(shift), f"g {kind}, __prefix long, __ranks {ranks}, buckets array<long>, counts array<long>")
        each = found.select("g", "__prefix", "__ranks", F.explode(F.arrays_zip("buckets", "counts")).alias("x"))
        return each.groupBy("g", "__prefix", F.col("x.buckets").alias("__bucket")).agg(F.first("__ranks").alias("__ranks"), F.sum("x.counts").alias("__n"))

    n = stored(pairs.mapInArrow(sized, f"g {kind}, n long").groupBy("g").agg(F.sum("n").alias("n")).where("n > 0"), "pairwise")
    middle = selection.by_counts(n, ["g"], {"median": 0.5}, counted)
    both = n.join(middle.withColumnRenamed("g", "of"), F.col("g").eqNullSafe(F.col("of")))
    return both.select(F.col("g").alias(group), F.col("n").alias("pairs"), "median")


def pearson_abs(a: Column, b: Column, least: int = 100) -> Column:
    """Absolute correlation over the shorter length; 0 for fewer than `least` values."""
    n = F.least(F.size(a), F.size(b))
    x, y = F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n)
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda s, q: s + q)
    mx, my = total(x) / n, total(y) / n
    dx, dy = F.transform(x, lambda q: q - mx), F.transform(y, lambda q: q - my)
    return F.when(n < least, F.lit(0.0)).otherwise(F.coalesce(F.abs(F.try_divide(dot(dx, dy), F.sqrt(dot(dx, dx) * dot(dy, dy)))), F.lit(0.0)))
