"""I-Match fingerprints: several hashes of a text's terms within a band of inverse document frequency.

A term is a word of the lower-cased text (ASCII letters lowered). Its document frequency is counted over all
texts; the lexicon holds the terms in at least a `low` and at most a `high` share of the documents. No more
terms than (mean distinct terms of a document) / `low` can reach the lower bound, whatever the corpus holds,
so the lexicon is small enough to broadcast, as a table of its terms' 64-bit hashes: of two slots that a hash
names, one holds it whole (cuckoo hashing). The table has 16 to 32 bytes for each term of the lexicon, and the
band is that of the exact terms at every size.

The lexicon is cut at random, by a hash of the term, into subsets at several rates; each subset's terms in a
text are sorted, distinct and hashed. A fingerprint is the list of these hashes, empty where a text has no
term of the subset, and last the hash of the whole band: of all lexicon terms of the text, or of all its terms
where none is in the lexicon. The likeness of two fingerprints is the share of equal hashes among those that
are not empty in both; 1 if all are empty in both, which only texts without a term are.

Only SQL functions run, in the JVM. Texts are shuffled once, by range of id, where each row meets the next one and both
of its fingerprints are made. At most ten ranges for each shuffle partition are cut at quantiles of the ids, then
evenly; an id that holds many rows, or the null id, is cut by a hash of the text.

Defined cases: a null text is the empty text, with an empty fingerprint; rows of one id follow each other in
order of a hash of their text, null ids come last; a single document is its own next; an empty table gives an
empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .stored import Scratch

#: One in so many lexicon terms belongs to a subset; so many subsets of each rate.
RATES = (32, 128, 512)
SUBSETS = 8
BLANKS = r"[\x20\x09-\x0D]+"


def terms_of(text: Column) -> Column:
    lowered = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.filter(F.array_distinct(F.split(lowered, BLANKS)), lambda t: t != "")


def lexicon(texts: DataFrame, low: float, high: float) -> DataFrame:
    """(hash) of the terms in the band."""
    n = texts.count()
    terms = F.transform(terms_of(F.col("text")), lambda t: F.xxhash64(t))
    df = texts.select(F.explode(terms).alias("hash")).groupBy("hash").agg(F.count("*").alias("df"))
    return df.where((F.col("df") >= max(2.0, low * n)) & (F.col("df") <= high * n)).select("hash")


def _slots_of(h: int, slots: int) -> tuple[int, int]:
    return h & (slots - 1), (h >> 32) & (slots - 1)


def marks_of(hashes: DataFrame) -> bytes:
    """A cuckoo table of 8-byte slots, under half full; a free slot holds a number that names other slots."""
    held = [h & (2**64 - 1) for (h,) in hashes.toLocalIterator()]
    slots = 2
    while slots < 2 * len(held) + 2:
        slots *= 2
    while (table := _cuckoo(held, slots)) is None:
        slots *= 2
    return b"".join((((k ^ 1) << 32 | k ^ 1) if (h := table.get(k)) is None else h).to_bytes(8, "big") for k in range(slots))


def _cuckoo(hashes: list[int], slots: int) -> dict[int, int] | None:
    """Slot to hash, each in one of its two; None if a hash finds no place."""
    table: dict[int, int] = {}
    for h in hashes:
        at = _slots_of(h, slots)[0]
        for _ in range(500):
            out = table.get(at)
            table[at] = h
            if out is None:
                break
            one, two = _slots_of(out, slots)
            h, at = out, two if at == one else one
        else:
            return None
    return table


def _in_band(term: Column, marks: bytes) -> Column:
    slots, table = len(marks) // 8, F.lit(marks)

    def holds(h: Column) -> Column:
        own = F.unhex(F.lpad(F.hex(h), 16, "0"))
        at = lambda shift: F.shiftrightunsigned(h, shift).bitwiseAND(F.lit(slots - 1).cast("long")).cast("int")
        return F.exists(F.array(at(0), at(32)), lambda slot: F.substring(table, slot * 8 + 1, F.lit(8)) == own)

    # a lambda over a one-element array binds the hash once
    return F.exists(F.array(F.xxhash64(term)), holds)


def fingerprint(text: Column, marks: bytes) -> Column:
    """The hashes of all lexicon subsets, an array of texts, empty where a text has no term of the subset; last that of the whole band."""
    terms = terms_of(text)
    held = F.filter(terms, lambda t: _in_band(t, marks))
    marked = F.transform(F.array_sort(held), lambda t: F.struct(t.alias("t"), F.xxhash64(t).alias("h")))

    def hashed(marked: Column) -> Column:
        return F.concat(*[F.transform(F.array(at_rate(marked, k, n)), of_rate)[0] for k, n in enumerate(RATES)], F.array(whole(marked)))

    def whole(marked: Column) -> Column:
        own = F.when(F.size(marked) > 0, F.transform(marked, lambda x: x["t"])).otherwise(F.array_sort(terms))
        return F.when(F.size(own) > 0, F.substring(F.md5(F.array_join(own, " ").cast("binary")), 1, 16)).otherwise(F.lit(""))

    def at_rate(marked: Column, k: int, n: int) -> Column:
        part = F.transform(marked, lambda x: F.struct(x["t"].alias("t"), F.shiftrightunsigned(x["h"], 12 * k).bitwiseAND(F.lit(n - 1).cast("long")).cast("int").alias("s")))
        return F.filter(part, lambda x: x["s"] < SUBSETS)

    def of_rate(few: Column) -> Column:
        return F.array(*[one_of(few, j) for j in range(SUBSETS)])

    def one_of(few: Column, j: int) -> Column:
        own = F.transform(F.filter(few, lambda x: x["s"] == j), lambda x: x["t"])
        return F.when(F.size(own) > 0, F.substring(F.md5(F.array_join(own, " ").cast("binary")), 1, 8)).otherwise(F.lit(""))

    # a lambda over a one-element array binds the marked terms once
    return F.transform(F.array(marked), hashed)[0]


def likeness(a: Column, b: Column) -> Column:
    pairs = F.filter(F.arrays_zip(a.alias("a"), b.alias("b")), lambda p: (p["a"] != "") | (p["b"] != ""))
    equal = F.size(F.filter(pairs, lambda p: p["a"] == p["b"]))
    return F.when(F.size(pairs) == 0, F.lit(1.0)).otherwise(equal / F.greatest(F.size(pairs), F.lit(1)))


def _place(sorted_values: list[int], x: Column, step: int = 32) -> Column:
    """Of sorted values, the number (from 1) of the last one that is not above x, or 1; in two levels."""
    tops = F.array(*[F.lit(v) for v in sorted_values[::step]])
    parts = F.array(*[F.array(*[F.lit(v) for v in sorted_values[k : k + step]]) for k in range(0, len(sorted_values), step)])
    upto = lambda values: F.greatest(F.size(F.filter(values, lambda v: v <= x)), F.lit(1))
    top = upto(tops)
    return (top - 1) * step + upto(F.element_at(parts, top))


def _ranges(rows: DataFrame, ranges: int, quantiles: int = 1024) -> Column:
    """A number of about `ranges` ranges that follows the order of (id, hash of the text)."""
    k = min(quantiles, ranges)
    cuts, held, n = rows.agg(F.percentile_approx("id", [j / k for j in range(k + 1)], 100 * k), F.count("id"), F.count("*")).first()
    cuts = [int(c) for c in cuts or [0]]
    lows = sorted(set(cuts))
    inner = -(-ranges // len(lows))
    # an id that stands at several quantiles is cut by hash
    slices = [max(1, -(-(cuts.count(c) - 1) * ranges // k)) for c in lows]
    widths = [max(1, -(-(b - a - 1) // inner)) for a, b in zip(lows, [*lows[1:], lows[-1] + 1])]
    wide = inner + max(slices)
    of_null = max(1, -(-(n - held) * ranges // max(1, n)))
    array = lambda values: F.array(*[F.lit(v).cast("long") for v in values])
    unit = F.col("h") / F.lit(2.0**64) + 0.5
    sliced = lambda m: F.least(F.floor(unit * m), m - 1)
    place = _place(lows, F.col("id"))
    low, own = F.element_at(array(lows), place), F.element_at(array(slices), place)
    step = F.least(F.floor((F.col("id") - low - 1) / F.element_at(array(widths), place)), F.lit(inner - 1))
    within = F.when(F.col("id") <= low, sliced(own)).otherwise(own + step)
    return F.when(F.col("id").isNull(), F.lit((len(lows) + 1) * wide) + sliced(F.lit(of_null))).otherwise(place * wide + within).cast("long")


def _dealt(rows: DataFrame, n: int, scratch: Scratch, rows_in_range: int) -> DataFrame:
    """Of (id, text): dealt by range, with `h` and `range`; and at the end of each range, marked `extra`, the first row of the next one."""
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.withColumn("h", F.xxhash64("text"))
    ranged = rows.withColumn("range", _ranges(rows, max(1, min(-(-n // rows_in_range), 10 * partitions)))).withColumn("extra", F.lit(0))
    # there are at most ten ranges or so for a partition
    firsts = ranged.groupBy("range").agg(F.min(F.struct(F.col("id").isNull().alias("last"), "id", "h")).alias("least"))
    follow = firsts.select("range", "least", F.lag("range").over(Window.orderBy("range")).alias("from"), F.max("range").over(Window.partitionBy()).alias("end"))
    follow = follow.select("range", "least", F.coalesce("from", "end").alias("from"))
    at_first = (F.col("id").eqNullSafe(F.col("least.id"))) & (F.col("h") == F.col("least.h"))
    found = ranged.join(F.broadcast(follow), "range").where(at_first).groupBy("from").agg(F.min("text").alias("text"))
    found = scratch.put(found.select(F.lit(None).cast("long").alias("id"), "text", F.lit(0).cast("long").alias("h"), F.col("from").alias("range"), F.lit(1).alias("extra")))
    return ranged.select("id", "text", "h", "range", "extra").union(found).repartition("range")


def with_fingerprints(documents: DataFrame, *, doc_id: str = "doc_id", text: str = "text", low: float = 0.001, high: float = 0.1, rows_in_range: int = 2000) -> DataFrame:
    """(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every row.

    The edited text has its last half replaced by as much of the next document's beginning.
    """
    rows = documents.select(F.col(f"`{doc_id}`").cast("long").alias("id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    marks = marks_of(lexicon(rows, low, high))
    order = Window.partitionBy("range").orderBy("extra", F.col("id").asc_nulls_last(), "h", "text")
    rows = _dealt(rows, documents.count(), Scratch(documents.sparkSession, "imatch"), rows_in_range)
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    rows = rows.withColumn("next_text", F.coalesce(F.lead("text").over(order), F.lit(""))).withColumn("n_chars", n.cast("long"))
    rows = rows.withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half)))
    rows = rows.withColumn("prints", F.transform(F.array("text", "edited"), lambda t: fingerprint(t, marks)))
    rows = rows.withColumn("print", F.col("prints")[0]).withColumn("edited_print", F.col("prints")[1]).withColumn("next_print", F.lead("print").over(order)).where("extra = 0")
    return rows.select(
        "id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), F.array_join("print", ".").alias("fingerprint"),
        F.array_join("edited_print", ".").alias("edited_fingerprint"), likeness(F.col("print"), F.col("edited_print")).alias("near_edited"),
        likeness(F.col("print"), F.col("next_print")).alias("near_next"),
    )
