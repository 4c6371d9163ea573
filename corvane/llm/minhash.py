"""Near duplicates by MinHash with tensored banding, every link confirmed on the full shingle sets.

A document's set holds the distinct five-word shingles of its whole text. Documents with equal sets form
a class, and only one of each class is compared. Two collections of `side` bands are made, each band of
two minhash values; table (i, j) is keyed by band i of the first and band j of the second. So side * side
tables of four values each come from 4 * side minhash values, not from 4 * side * side. With side = 16 a
pair at similarity 0.75 meets in no table with a chance of about 4e-6, and less above.

Table keys are formed only from bands that some other class shares: a key with an unshared part
can't be shared. Links are then found in two steps, none of which lists the pairs of a group:

1. every class is compared with the smallest class that it meets in any table; a confirmed link labels it
   with that class;
2. where tables connect classes, directly or by others, that links do not, the classes outside the largest linked
   group of the connected ones are compared with all others, in pairs of blocks. Blocks first hold bands only; the sets
   of those that share a table across groups follow. Pairs that share a table are confirmed on the spot, links that
   follow from earlier ones are skipped, and only links that join groups leave the task.

Defined cases: a null, empty or blank text has the empty set and is linked with nothing; a text of fewer
than five words has its whole sequence as one shingle; rows of one id are one document, so that all their texts
are linked, but a row of it without words stays alone; a null id gets a null component and is kept, and links
nothing; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stored import Scratch, components
from .textblocks import BLANK_SPLIT, U64, Words, mix, shingles, slices

SHINGLE = 5
PERCENT = 75
SIDE = 16
BLOCK = 512
SLICE = 1 << 20
_MULTIPLIERS = np.random.default_rng(5).integers(1, 2**63, 4 * SIDE, dtype=np.uint64) * U64(2) + U64(1)


def _sets(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    return shingles(Words(texts, BLANK_SPLIT), SHINGLE)


def _bands(values: np.ndarray, bounds: np.ndarray, filled: np.ndarray) -> np.ndarray:
    """2 * SIDE band values for each non-empty set; the band's number is part of the value."""
    starts = bounds[:-1][filled]
    minima = np.empty((len(starts), 4 * SIDE), dtype=np.uint64)
    for k, m in enumerate(_MULTIPLIERS):
        x = values * m
        x ^= x >> U64(32)
        minima[:, k] = np.minimum.reduceat(x, starts) if len(starts) else 0
    return mix(minima[:, 0::2] * U64(0x9E3779B97F4A7C15) + mix(minima[:, 1::2]) + np.arange(2 * SIDE, dtype=np.uint64))


def _digest(items: np.ndarray) -> bytes:
    return hashlib.blake2b(items.tobytes(), digest_size=16).digest()


def sketch(documents: DataFrame, doc_id: str, text: str, slice_bytes: int = SLICE) -> DataFrame:
    """(id, n_shingles, digest of the set, bands) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", slice_bytes):
            values, bounds = _sets(batch.column("text").to_pylist())
            size = np.diff(bounds)
            filled = np.flatnonzero(size)
            bands = _bands(values, bounds, filled).view(np.int64).reshape(-1)
            offsets = np.concatenate([[0], np.cumsum((size > 0) * 2 * SIDE)])
            digests = [_digest(values[a:b]) if b > a else None for a, b in zip(bounds[:-1], bounds[1:])]
            yield pa.RecordBatch.from_pydict({
                "id": batch.column("id"), "n_shingles": pa.array(size, pa.int64()), "digest": pa.array(digests, pa.binary()),
                "bands": pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(bands)),
            })

    return documents.select(F.col(doc_id).cast("long").alias("id"), F.col(text).cast("binary").alias("text")).mapInArrow(
        run, "id long, n_shingles long, digest binary, bands array<long>"
    )


def _sets_of(texts: DataFrame, wanted: DataFrame, slice_bytes: int = SLICE) -> DataFrame:
    """(k, items) of the wanted (id, k, digest): of the texts of an id, the set with that digest, sorted, as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", slice_bytes):
            values, bounds = _sets(batch.column("text").to_pylist())
            held = [values[a:b] for a, b in zip(bounds[:-1], bounds[1:])]
            rows = [(k, x.tobytes()) for k, x, digest in zip(batch.column("k").to_pylist(), held, batch.column("digest").to_pylist()) if _digest(x) == digest]
            yield pa.RecordBatch.from_pydict({"k": pa.array([r[0] for r in rows], pa.int64()), "items": pa.array([r[1] for r in rows], pa.binary())})

    # the ids grow with the corpus, so they are never broadcast
    return texts.join(wanted.hint("merge"), "id").select("k", "digest", "text").mapInArrow(run, "k long, items binary")


def _confirm(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Of candidate (a, b), those whose sets reach the threshold."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = ([np.frombuffer(x.as_buffer(), dtype=np.uint64) for x in batch.column(c)] for c in "xy")
            keep = [_linked(x, y) for x, y in zip(*sets)]
            yield pa.RecordBatch.from_pydict({"a": batch.column("a"), "b": batch.column("b")}).filter(pa.array(keep, pa.bool_()))

    joined = pairs.join(sets.select(F.col("k").alias("a"), F.col("items").alias("x")), "a").join(sets.select(F.col("k").alias("b"), F.col("items").alias("y")), "b")
    return joined.select("a", "b", "x", "y").mapInArrow(compare, "a long, b long")


def _near(labels: np.ndarray, bands: np.ndarray, left: np.ndarray, right: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(place on the left, place on the right) of pairs of different labels that share a table, a few rows of the left at a time."""
    step = max(1, (1 << 22) // max(1, 2 * SIDE * len(right)))
    for low in range(0, len(left), step):
        part = left[low : low + step]
        equal = bands[part][:, None, :] == bands[right][None, :, :]
        x, y = np.nonzero(equal[:, :, :SIDE].any(2) & equal[:, :, SIDE:].any(2) & (labels[part][:, None] != labels[right][None, :]))
        yield part[x], right[y]


def _joins(labels: np.ndarray, keys: np.ndarray, sets: list[np.ndarray], near: Iterator[tuple[np.ndarray, np.ndarray]]) -> list[tuple[int, int]]:
    """Confirmed links of near pairs that join different groups; links already implied are skipped."""
    parent = {int(x): int(x) for x in np.unique(labels)}

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for left, right in near:
        for x, y in zip(left.tolist(), right.tolist()):
            a, b = root(int(labels[x])), root(int(labels[y]))
            if a != b and _linked(sets[x], sets[y]):
                parent[max(a, b)] = min(a, b)
                out.append((int(keys[x]), int(keys[y])))
    return out


def _linked(x: np.ndarray, y: np.ndarray) -> bool:
    if 100 * min(len(x), len(y)) < PERCENT * max(len(x), len(y)):
        return False
    both = np.concatenate([x, y])
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= PERCENT * (len(both) - common)


PAIRED = "c long, inner boolean, p int, q int, side int, k long, label long, bands array<long>"


def _pairs_of_blocks(batches: Iterator[pa.RecordBatch], with_sets: bool) -> Iterator[tuple]:
    """(rows, labels, sides of each pair of blocks as (left, right), near pairs); rows come sorted by pair."""
    held: list[tuple] = []
    names = ["c", "inner", "p", "q", "side", "k", "label", "bands", *(["items"] if with_sets else [])]

    def settle() -> tuple:
        labels, bands, side = np.array([r[6] for r in held]), np.array([r[7] for r in held]), np.array([r[4] for r in held])
        every = np.arange(len(held))
        inside = held[0][1] and held[0][2] == held[0][3]
        left, right = (every, every) if inside else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
        return list(held), labels, _near(labels, bands, left, right)

    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in names)):
            if held and held[0][:4] != row[:4]:
                yield settle()
                held.clear()
            held.append(row)
    if held:
        yield settle()


def _involved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of a pair of blocks that share a table with one of another label."""
    for rows, _, near in _pairs_of_blocks(batches, False):
        use = np.zeros(len(rows), dtype=bool)
        for left, right in near:
            use[left] = use[right] = True
        kept = [rows[k] for k in np.flatnonzero(use)]
        kinds = (pa.int64(), pa.bool_(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
        columns = zip(*kept) if kept else [[]] * len(kinds)
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds)], names=["c", "inner", "p", "q", "side", "k", "label", "bands"])


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links across labels within each pair of blocks."""
    for rows, labels, near in _pairs_of_blocks(batches, True):
        found = _joins(labels, np.array([r[5] for r in rows]), [np.frombuffer(r[8], dtype=np.uint64) for r in rows], near)
        a, b = zip(*found) if found else ((), ())
        yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _in_pairs_of_blocks(labelled: DataFrame, bands: DataFrame) -> DataFrame:
    """Of (k, c, label): where a component c has several labels, every pair of blocks that holds two of them.

    The classes of a component's commonest label need no comparison with each other, so copies are as many as the
    others' blocks, which are few.
    """
    by_label = labelled.groupBy("c", "label").agg(F.count("*").alias("n"))
    open_ = by_label.groupBy("c").agg(F.max_by("label", F.struct("n", "label")).alias("main"), F.max("n").alias("inner"), F.sum("n").alias("n")).where("n > inner")
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    open_ = open_.select("c", "main", blocks(F.col("inner")).alias("mains"), blocks(F.col("n") - F.col("inner")).alias("others"))
    rest = labelled.join(open_, "c").join(bands, "k")
    own = lambda n: F.pmod(F.xxhash64("k"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    main, other = rest.where("label = main"), rest.where("label <> main")
    lay = lambda frame, inner, p, q, side: frame.select("c", F.lit(inner).alias("inner"), p.alias("p"), q.alias("q"), side.alias("side"), "k", "label", "bands")
    paired = lay(main.withColumn("at", each("others")), False, own("mains"), F.col("at"), F.lit(0))
    paired = paired.union(lay(other.withColumn("at", each("mains")), False, F.col("at"), own("others"), F.lit(1)))
    both = other.withColumn("at", each("others")).withColumn("own", own("others"))
    side = F.when(F.col("own") <= F.col("at"), 0).otherwise(1)
    return paired.union(lay(both, True, F.least("own", "at"), F.greatest("own", "at"), side))


def _stars(tables: DataFrame) -> DataFrame:
    """(a, b) that connect the same classes as (k, lead) does, with fewer rows.

    A class of a large group has up to SIDE * SIDE leads. It keeps the smallest, and its other leads, which many
    classes share, are hung under that one.
    """
    leads = tables.where("k <> lead").groupBy("k").agg(F.sort_array(F.collect_set("lead")).alias("leads"))
    under = leads.select(F.col("leads")[0].alias("b"), F.explode(F.slice("leads", 2, SIDE * SIDE)).alias("a")).select("a", "b").distinct()
    return leads.select(F.col("k").alias("a"), F.col("leads")[0].alias("b")).union(under)


def near_duplicates(documents: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_shingles, component_id, kept) of every row."""
    spark = documents.sparkSession
    scratch = Scratch(spark, "minhash")
    rows = scratch.put(sketch(documents, doc_id, text))
    filled = rows.where("n_shingles > 0 and id is not null")
    # the numbers of classes are fixed once they are written
    classes = scratch.put(filled.groupBy("digest").agg(F.min("id").alias("rep")).withColumn("k", F.monotonically_increasing_id()))
    repeated = scratch.put(filled.groupBy("id").agg(F.count("*").alias("n"), F.min("digest").alias("low"), F.max("digest").alias("high")).where("n > 1"))
    once = (lambda frame: frame) if repeated.isEmpty() else (lambda frame: frame.dropDuplicates(["k"]))
    reps = scratch.put(once(rows.join(classes.select("digest", F.col("rep").alias("id"), "k"), ["digest", "id"]).select("k", "bands")))
    n_left = SIDE

    # bands that two classes share, and the table keys formed from them
    banded = reps.select("k", F.posexplode("bands").alias("n", "band"))
    shared = banded.groupBy("band").agg(F.count("*").alias("c")).where("c > 1").select("band")
    mine = banded.join(shared, "band").groupBy("k").agg(F.collect_list(F.struct("n", "band")).alias("bands"))
    left = F.filter("bands", lambda x: x["n"] < n_left)
    right = F.filter("bands", lambda x: x["n"] >= n_left)
    tables = mine.select("k", F.explode(left).alias("l"), right.alias("right")).select("k", "l", F.explode("right").alias("r"))
    tables = tables.select("k", F.xxhash64("l.band", "r.band").alias("key"))
    leads = tables.groupBy("key").agg(F.min("k").alias("lead"), F.count("*").alias("c")).where("c > 1").select("key", "lead")
    tables = scratch.put(tables.join(leads, "key").select("k", "lead").distinct())

    texts = documents.select(F.col(doc_id).cast("long").alias("id"), F.col(text).cast("binary").alias("text"))
    nearest = scratch.put(tables.groupBy("k").agg(F.min("lead").alias("lead")).where("k <> lead").select(F.col("lead").alias("a"), F.col("k").alias("b")))
    wanted = classes.join(tables.select("k").distinct(), "k", "left_semi").select(F.col("rep").alias("id"), "k", "digest")
    sets = scratch.put(once(_sets_of(texts, wanted)))
    links = scratch.put(_confirm(nearest, sets))

    # classes that tables connect but links do not yet
    met = scratch.put(components(_stars(tables), scratch).select(F.col("node").alias("k"), F.col("root").alias("c")))
    scratch.drop(tables, nearest)
    labelled = met.join(links.select(F.col("b").alias("k"), F.col("a").alias("root")), "k", "left")
    labelled = scratch.put(labelled.select("k", "c", F.coalesce("root", "k").alias("label")))
    in_order = lambda frame: frame.repartition("c", "inner", "p", "q").sortWithinPartitions("c", "inner", "p", "q")
    involved = scratch.put(in_order(_in_pairs_of_blocks(labelled, reps)).mapInArrow(_involved, PAIRED))
    found = scratch.put(in_order(involved.join(sets, "k").select(*involved.columns, "items")).mapInArrow(_across, "a long, b long"))
    scratch.drop(labelled, met, reps, involved, sets)
    links = links.union(found)
    if not repeated.where("low <> high").isEmpty():
        # all texts of one id are linked
        number = classes.select("digest", "k")
        texts_of = filled.select("id", "digest").distinct().join(repeated.where("low <> high").select("id", "low"), "id")
        same = texts_of.join(number.withColumnRenamed("k", "a"), "digest").select("a", F.col("low").alias("digest")).join(number.withColumnRenamed("k", "b"), "digest")
        links = links.union(same.select("a", "b"))
    roots = scratch.put(components(links, scratch))
    scratch.drop(found, repeated)

    # a component's id is the smallest document in it
    of_class = scratch.put(classes.join(roots.withColumnRenamed("node", "k"), "k").select("digest", "rep", "root"))
    least = of_class.groupBy("root").agg(F.min("rep").alias("component"))
    linked = of_class.join(least, "root").select("digest", "component")
    of_class = classes.join(linked, "digest", "left").select("digest", F.coalesce("component", "rep").alias("component"))
    out = rows.join(of_class, "digest", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return out.select("id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"))
