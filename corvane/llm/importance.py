"""Importance resampling toward a target: documents drawn by how much likelier their n-grams are in the target texts.

Features are all runs of one to `longest_run` words, hashed by crc32 into `buckets`. Tasks count buckets in arrays, one
row a bucket leaves each task; the summed counts of source and target (`buckets` numbers each) give every bucket a gain
in thousandths of a nat, rounded down. A document's weight is the mean gain of its features, rounded down, and its score adds Gumbel
noise from a sha256 of seed and id: the highest scores are a draw without replacement by weight.

Ranks need no sort of all documents. Scores are whole numbers, so a histogram of them is small: gains are at most
1000 times the log of the number of features, and noise lies between -3129 and 22181, some 100,000 scores at most. Summing the
histogram from the top gives for each score how many rows score higher, and the score at which the draw ends. Rows from
that score on are numbered by id within each score. A score is cut into slices by id, whose counts add up, so many
tasks number one score; an id that fills several slices is dealt over them.

Defined cases: a null or empty text has no features, weight 0 and is never drawn where `least_words` is above 0; a
null id counts as the empty text in the noise and comes last among equal scores; rows of one id and score have
consecutive ranks in no fixed order; an empty target gives gains from the source counts alone; an empty table gives
no rows. Columns in `keep` come back as they are, whatever their names, in the struct `row`.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .stored import Scratch
from .textblocks import ALNUM, Words, slices

_ONES = np.uint32(0xFFFFFFFF)


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1).astype(np.uint32)
    return table


_CRC = _crc_table()
#: Words up to this many bytes are hashed together; longer ones one by one.
_SHORT = 48


def _shifts() -> np.ndarray:
    """[length * 4 + which byte, its value]: a crc register after so many zero bytes, byte by byte of the register."""
    out = np.zeros((_SHORT + 1, 4, 256), dtype=np.uint32)
    for j in range(4):
        out[0, j] = np.arange(256, dtype=np.uint32) << np.uint32(8 * j)
    for n in range(1, _SHORT + 1):
        out[n] = _CRC[out[n - 1] & 255] ^ (out[n - 1] >> np.uint32(8))
    return out.reshape(-1, 256)


_SHIFTS = _shifts().reshape(-1)


def _shifted(register: np.ndarray, length: np.ndarray) -> np.ndarray:
    at = (length * 1024).astype(np.int64)
    out = _SHIFTS[at + (register & np.uint32(255))]
    for j in (1, 2, 3):
        out ^= _SHIFTS[at + 256 * j + ((register >> np.uint32(8 * j)) & np.uint32(255))]
    return out


def word_crcs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The crc32 of each byte span."""
    lengths = ends - starts
    order = np.argsort(-np.minimum(lengths, _SHORT + 1), kind="stable")
    at, size = starts[order], lengths[order]
    low = int(np.count_nonzero(size > _SHORT))
    out = np.empty(len(starts), dtype=np.uint32)
    for k in range(low):
        out[order[k]] = zlib.crc32(data[at[k] : at[k] + size[k]])
    at, size, register = at[low:], size[low:], np.full(len(starts) - low, _ONES)
    alive = np.searchsorted(-size, -np.arange(1, (int(size[0]) if len(size) else 0) + 1), side="right")
    for k, n in enumerate(alive):
        part = register[:n]
        register[:n] = _CRC[(part ^ data[at[:n] + k]) & 255] ^ (part >> np.uint32(8))
    out[order[low:]] = register ^ _ONES
    return out


def run_crcs(words: Words, longest_run: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text, crc32) of all runs of 1, 2, ... words joined by a space."""
    starts, ends, text = words.starts, words.ends, words.text
    one = word_crcs(words.data, starts, ends)
    yield text, one
    crc, lengths = one, ends - starts
    for k in range(1, longest_run):
        n = max(0, len(starts) - k)
        # state after a space; crc32(a + b) follows from the states of a and of b alone, as the register is linear
        state = crc[:n] ^ _ONES
        state = _CRC[(state ^ np.uint32(32)) & 255] ^ (state >> np.uint32(8))
        added = lengths[k : k + n]
        crc = _shifted(state ^ _ONES, np.minimum(added, _SHORT)) ^ one[k : k + n]
        for i in np.flatnonzero(added > _SHORT):
            crc[i] = zlib.crc32(words.data[starts[i + k] : ends[i + k]], int(state[i] ^ _ONES))
        inside = text[:n] == text[k : k + n]
        yield text[:n][inside], crc[inside]


def _features(batch: pa.RecordBatch, buckets: int, longest_run: int) -> tuple[Words, list[tuple[np.ndarray, np.ndarray]]]:
    words = Words(batch.column("text").to_pylist(), ALNUM)
    return words, [(text, (crc % np.uint32(buckets)).astype(np.int64)) for text, crc in run_crcs(words, longest_run)]


def bucket_counts(documents: DataFrame, *, text: str = "text", buckets: int = 10_000, longest_run: int = 2, slice_bytes: int = 4 << 20) -> np.ndarray:
    """How often each bucket occurs in all texts. At most `buckets` rows reach the driver, from tasks' own sums."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in slices(batches, "text", slice_bytes):
            for _, bucket in _features(batch, buckets, longest_run)[1]:
                total += np.bincount(bucket, minlength=buckets)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(found, pa.int32()), "n": pa.array(total[found])})

    rows = documents.select(F.col(f"`{text}`").cast("binary").alias("text")).mapInArrow(count, "bucket int, n long")
    out = np.zeros(buckets, dtype=np.int64)
    for r in rows.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of a nat by which each bucket is likelier in the target, with one more count for every bucket; rounded down."""
    n, s_all, t_all = len(source), float(source.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((float(t) + 1) * (s_all + n) / ((float(s) + 1) * (t_all + n)))) for s, t in zip(source, target)], dtype=np.int64)


def noise(seed: int, doc_id: int | str | None) -> int:
    """Gumbel noise in thousandths, rounded down, from a sha256 of seed and id."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(documents: DataFrame, gain: np.ndarray, *, doc_id: str = "doc_id", text: str = "text", seed: int = 7, longest_run: int = 2, keep: list[str] | None = None, slice_bytes: int = 4 << 20) -> DataFrame:
    """(id, n_features, n_words, weight, score) of each document, and `row` where `keep` names columns."""
    columns = [F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").cast("binary").alias("text")]
    kept = [F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row")] if keep else []
    read = documents.select(*columns, *kept)
    kind = read.schema["id"].dataType.simpleString()
    ddl = f"id {kind}, n_features long, n_words long, weight long, score long" + (f", row {read.schema['row'].dataType.simpleString()}" if keep else "")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", slice_bytes):
            words, found = _features(batch, len(gain), longest_run)
            sums, n = np.zeros(words.n_texts), np.zeros(words.n_texts, dtype=np.int64)
            for of, bucket in found:
                sums += np.bincount(of, weights=gain[bucket], minlength=words.n_texts)
                n += np.bincount(of, minlength=words.n_texts)
            weight = np.where(n > 0, sums.astype(np.int64) // np.maximum(n, 1), 0)
            add = np.array([noise(seed, i) for i in batch.column("id").to_pylist()], dtype=np.int64)
            out = {"id": batch.column("id"), "n_features": pa.array(n), "n_words": pa.array(words.counts), "weight": pa.array(weight), "score": pa.array(weight + add)}
            yield pa.RecordBatch.from_pydict(out | ({"row": batch.column("row")} if keep else {}))

    return read.mapInArrow(score, ddl)


def rank_offsets(histogram: list[tuple[int, int]], k: int) -> tuple[int | None, list[tuple[int, int]]]:
    """Of (score, count): the lowest score that a draw of k reaches, and (score, how many rows score higher) from there on."""
    ahead, out = 0, []
    for score, n in sorted(histogram, reverse=True):
        if ahead >= k:
            break
        out.append((score, ahead))
        ahead += n
    return (out[-1][0] if out else None), out


def ranked(rows: DataFrame, percent: int, least_words: int, id_slices: int = 64) -> DataFrame:
    """Stored rows of `scored` and a hash `deal`, with `rank`: 1, 2, 3... for the highest scores among those of at least `least_words` words, else null."""
    spark = rows.sparkSession
    able = rows.where(F.col("n_words") >= least_words)
    histogram = [(r["score"], r["n"]) for r in able.groupBy("score").agg(F.count("*").alias("n")).collect()]
    k = percent * sum(n for _, n in histogram) // 100
    cutoff, offsets = rank_offsets(histogram, k)
    none = F.lit(None).cast("long").alias("rank")
    if cutoff is None:
        return rows.select("*", none)
    above = (F.col("n_words") >= least_words) & (F.col("score") >= cutoff)
    # a sample of rows, so that an id of many rows stands at several cuts
    sample = sorted(r[0] for r in rows.where(F.col("id").isNotNull()).orderBy("deal").select("id").limit(64 * id_slices).collect())
    cuts = F.array(*[F.lit(sample[j * len(sample) // id_slices]) for j in range(1, id_slices)] if sample else []).cast(f"array<{rows.schema['id'].dataType.simpleString()}>")
    below, upto = F.size(F.filter(cuts, lambda c: c < F.col("id"))), F.size(F.filter(cuts, lambda c: c <= F.col("id")))
    piece = F.when(F.col("id").isNull(), id_slices + F.pmod("deal", F.lit(id_slices))).otherwise(below + F.pmod("deal", upto - below + 1))
    held = rows.withColumn("__piece", piece.cast("int")).where(above)
    counts = held.groupBy(F.col("score").alias("__score"), F.col("__piece").alias("__of")).agg(F.count("*").alias("__n"))
    earlier = Window.partitionBy("__score").orderBy("__of").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("__before", F.coalesce(F.sum("__n").over(earlier), F.lit(0))).drop("__n")
    # at most a row for each score of the histogram
    starts = spark.createDataFrame(offsets, "__from long, __ahead long")
    counts = counts.join(F.broadcast(starts), F.col("__score") == F.col("__from"))
    place = F.row_number().over(Window.partitionBy("score", "__piece").orderBy(F.col("id").asc_nulls_last()))
    drawn = held.withColumn("__place", place).join(counts, (F.col("score") == F.col("__score")) & (F.col("__piece") == F.col("__of")))
    rank = (F.col("__ahead") + F.col("__before") + F.col("__place")).cast("long")
    drawn = drawn.select(*rows.columns, F.when(rank <= k, rank).alias("rank"))
    return drawn.union(rows.where(~above).select("*", none))


def resample(documents: DataFrame, target: DataFrame, *, percent: int = 25, least_words: int = 20, buckets: int = 10_000, longest_run: int = 2, doc_id: str = "doc_id", text: str = "text", target_text: str = "text", seed: int = 7, keep: list[str] | None = None) -> DataFrame:
    """(id, n_features, n_words, weight, score, rank) of every document; the draw is where rank is not null.

    Texts are read twice and never shuffled; what is shuffled are the narrow rows from the cutoff score on.
    """
    how = {"buckets": buckets, "longest_run": longest_run}
    gain = gains(bucket_counts(documents, text=text, **how), bucket_counts(target, text=target_text, **how))
    rows = scored(documents, gain, doc_id=doc_id, text=text, seed=seed, longest_run=longest_run, keep=keep)
    # written once with its deal, so that rows are dealt alike whenever they are read again
    rows = rows.withColumn("deal", F.xxhash64(F.monotonically_increasing_id()))
    return ranked(Scratch(documents.sparkSession, "importance").put(rows), percent, least_words).drop("deal")


SQL = r"""
WITH c AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i::BIGINT, range(8)),
  lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384::BIGINT) ELSE a >> 1 END)) AS tab),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
df AS (SELECT doc_id, unnest(w) AS g FROM d UNION ALL SELECT doc_id, w[i] || ' ' || w[i + 1] FROM d, LATERAL (SELECT unnest(range(1, len(w))) AS i)),
bf AS (SELECT unnest(w) AS g FROM b UNION ALL SELECT w[i] || ' ' || w[i + 1] FROM b, LATERAL (SELECT unnest(range(1, len(w))) AS i)),
h AS (SELECT g, hex(encode(g)) AS x FROM (SELECT g FROM df UNION SELECT g FROM bf)),
k AS (SELECT g, xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, length(x) // 2), lambda j: ('0x' || substr(x, (1 + 2 * j)::INT, 2))::BIGINT)),
  lambda a, b: xor(a >> 8, tab[(xor(a, b) & 255) + 1]))) % 10000 AS bucket FROM h, c),
s AS (SELECT bucket, count(*) AS s FROM df JOIN k USING (g) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM bf JOIN k USING (g) GROUP BY bucket),
n AS (SELECT (SELECT count(*) FROM df)::DOUBLE AS s_all, (SELECT count(*) FROM bf)::DOUBLE AS t_all),
gain AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (s_all + 10000) / ((coalesce(s, 0) + 1)::DOUBLE * (t_all + 10000))))::BIGINT AS gain FROM s FULL JOIN t USING (bucket), n),
w AS (SELECT doc_id, count(*) AS n_features, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight FROM df JOIN k USING (g) JOIN gain USING (bucket) GROUP BY doc_id),
r AS (SELECT d.doc_id, len(d.w) AS n_words, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
  floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || d.doc_id::VARCHAR), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS noise FROM d LEFT JOIN w USING (doc_id)),
o AS (SELECT doc_id, row_number() OVER (ORDER BY weight + noise DESC, doc_id) AS place, count(*) OVER () AS n FROM r WHERE n_words >= 20)
SELECT r.doc_id, n_features, weight, weight + noise AS score, CASE WHEN place <= 25 * n // 100 THEN place END::BIGINT AS rank FROM r LEFT JOIN o USING (doc_id)
"""
