"""Mixing sources to target weights by Pareto order sampling, after whole copies that are certain.

Targets: a source's weight says its share of the mix, but no source gives more than `most` times its size;
what it can't give is shared among the others by weight. With s sources sorted by how soon they fill up,
the level is found in one pass over the sources, not by iterating.

Within a source whose target is r times its size, each document is taken floor(r) times for certain. The
rest is a sample without replacement of unequal probabilities: a document's inclusion probability p is in proportion
to its weight, at most 1, at the level where the sizes weighted by p come to the words still due. Documents of p = 1
are in for certain. The others are ranked by random odds divided by inclusion odds, u / (1 - u) / (p / (1 - p)),
and taken by rank while at least half of the next one fits in the words due, so the sample's size is fixed in words.
The random number u comes from an md5 of seed and id, so reruns agree. Weights are whole numbers; by
default the square root of a document's size, rounded down, so that longer documents are likelier.

Two passes read the texts, and neither shuffles them: the first stores each row's source, size, weight and u; from
those come the plan by source and the rank at which each source's sample ends; the second compares each
document's rank with its source's end. A running sum over a whole source would put it in one task. So the ranks
are cut into `slots` equal parts, whose sums say in which slot of each source the sample ends; only that slot is
summed row by row.

Defined cases: a null or empty text has size 0 and is taken 0 times its size; the null source is a source of
its own, last in order; rows of one id and size are taken together, in order of size where sizes differ; a weight that
is null or below 1 counts as 1; an empty table mixes to nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .stored import Scratch

WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: DataFrame, *, weights: tuple[int, ...] = (5, 2, 1), budget: float = 1.5, most: int = 2) -> DataFrame:
    """Of (source, source_size): (source, source_size, target). Sources weigh `weights` by code point order, repeating."""
    in_order = Window.orderBy(F.col("source").cast("binary").asc_nulls_last())
    k = (F.row_number().over(in_order) - 1) % len(weights)
    ranked = sizes.withColumn("w", F.element_at(F.array(*[F.lit(w) for w in weights]), k + 1).cast("long"))
    fills = Window.orderBy((F.col("source_size") / F.col("w")), F.col("source").cast("binary").asc_nulls_last())
    before = fills.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    ranked = ranked.withColumn("full_before", F.coalesce(F.sum("source_size").over(before), F.lit(0)) * most)
    ranked = ranked.withColumn("w_left", F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0)))
    ranked = ranked.withColumn("due", F.sum("source_size").over(everything) * F.lit(float(budget)))
    level = (F.col("due") - F.col("full_before")) / F.col("w_left")
    ranked = ranked.withColumn("level", F.when(level * F.col("w") <= F.col("source_size") * most, level))
    ranked = ranked.withColumn("level", F.max("level").over(everything))
    target = F.coalesce(F.least(F.col("level") * F.col("w"), (F.col("source_size") * most).cast("double")), (F.col("source_size") * most).cast("double"))
    return ranked.select("source", "source_size", target.alias("target"))


def uniform(seed: int, doc_id: Column) -> Column:
    """A number between 0 and 1 from seed and id, the same in any engine with md5."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}-"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary")), 1, 12)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / float(16**12)


def levels(classes: DataFrame) -> DataFrame:
    """Of (source, weight, words, rest), one row for each weight of a source: (source, level, certain_from, certain_words).

    Inclusion is weight * level; weights from `certain_from` on reach 1, and their words are in for certain. The heaviest
    weights fill up first: the level is that after the fewest of them at which no other weight exceeds 1.
    """
    heaviest = Window.partitionBy("source").orderBy(F.desc("weight"))
    before = heaviest.rowsBetween(Window.unboundedPreceding, -1)
    onwards = Window.partitionBy("source").orderBy("weight").rowsBetween(Window.unboundedPreceding, 0)
    rows = classes.withColumn("ahead", F.coalesce(F.sum("words").over(before), F.lit(0))).withColumn("bound", F.sum(F.col("weight") * F.col("words")).over(onwards))
    rows = rows.withColumn("level", F.try_divide(F.col("rest") - F.col("ahead"), "bound")).withColumn("lighter", F.lag("weight").over(heaviest))
    fits = rows.where(F.col("level") * F.col("weight") <= 1)
    return fits.groupBy("source").agg(F.max_by("level", "weight").alias("level"), F.max_by("lighter", "weight").alias("certain_from"), F.max_by("ahead", "weight").alias("certain_words"))


def _ranked(rows: DataFrame) -> DataFrame:
    """Of rows with `w`, `u` and `level`: their Pareto rank, mapped to (0, 1) so that slots are even."""
    p = F.col("w") * F.col("level")
    odds = F.when(p >= 1, 0.0).otherwise(F.try_divide(F.col("u") / (1 - F.col("u")), F.try_divide(p, 1 - p)))
    return rows.withColumn("rank", odds / (1 + odds))


def mix(documents: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source", weight: Column | None = None, seed: int = 7, slots: int = 4096, **targeting) -> DataFrame:
    """The documents with `size`, `source_size`, `target` and `taken`, all long but target; such columns, in any case of
    letters, are replaced."""
    held = [c for c in documents.columns if c.lower() not in ("size", "source_size", "target", "taken")]
    size = F.coalesce(F.regexp_count(F.col(f"`{text}`"), F.lit(WORD)), F.lit(0)).cast("long")
    w = F.floor(F.sqrt("size")) if weight is None else F.col("weight")
    row = F.struct(*[F.col(f"`{c}`") for c in held]).alias("row")
    given = (F.lit(1) if weight is None else weight).cast("long").alias("weight")
    read = documents.select(row, F.col(f"`{source}`").alias("source"), size.alias("size"), uniform(seed, F.col(f"`{doc_id}`")).alias("u"), given)
    read = read.withColumn("w", F.greatest(F.coalesce(w, F.lit(1)), F.lit(1)).cast("long")).drop("weight")
    scratch = Scratch(documents.sparkSession, "mixing")
    rows = scratch.put(read.drop("row"))

    plan = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), **targeting)
    copies = F.coalesce(F.floor(F.try_divide("target", "source_size")).cast("long"), F.lit(0))
    plan = plan.withColumn("copies", copies).withColumn("rest", F.col("target") - F.col("copies") * F.col("source_size"))
    classes = rows.where("size > 0").groupBy("source", F.col("w").alias("weight")).agg(F.sum("size").alias("words"))
    classes = classes.join(plan.select(F.col("source").alias("s"), "rest"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    level = levels(classes).withColumnRenamed("source", "s")
    plan = scratch.put(plan.join(level, F.col("source").eqNullSafe(F.col("s")), "left").drop("s").withColumnRenamed("source", "s"))
    # sources are few as a rule; a plan of more than 100,000 is joined by shuffles
    few = F.broadcast if plan.count() <= 100_000 else (lambda frame: frame)

    with_plan = lambda frame: frame.join(few(plan), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    uncertain = (F.col("size") > 0) & (F.col("rest") > 0) & F.coalesce(F.col("w") < F.col("certain_from"), F.lit(True))
    drawn = _ranked(with_plan(rows).where(uncertain)).withColumn("slot", F.least(F.floor(F.col("rank") * slots), F.lit(slots - 1)))
    # the words due after the certain documents, slot by slot
    sums = drawn.groupBy("source", "slot").agg(F.sum("size").alias("words"), F.first(F.col("rest") - F.coalesce("certain_words", F.lit(0))).alias("due"))
    ahead = F.coalesce(F.sum("words").over(Window.partitionBy("source").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ends = sums.withColumn("ahead", ahead).where("ahead <= due and ahead + words > due")
    ends = ends.select(F.col("source").alias("s"), F.col("slot").alias("end"), "ahead", "due")
    inside = drawn.join(few(ends), F.col("source").eqNullSafe(F.col("s")) & (F.col("slot") == F.col("end")))
    upto = F.sum("size").over(Window.partitionBy("source").orderBy("rank", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    # a document is in while half of it fits: the first one out ends the sample
    out = inside.withColumn("upto", F.col("ahead") + upto).where(F.col("upto") - F.col("size") / 2 > F.col("due"))
    out = out.groupBy("source").agg(F.min(F.struct("rank", "size")).alias("first_out"))
    after = ends.select("s", "end").join(out.select(F.col("source").alias("o"), "first_out"), F.col("s").eqNullSafe(F.col("o")), "left").drop("o")
    after = scratch.put(after)

    ranked = _ranked(with_plan(read))
    ended = ranked.join(few(after.withColumnRenamed("s", "e")), F.col("source").eqNullSafe(F.col("e")), "left")
    slot = F.least(F.floor(F.col("rank") * slots), F.lit(slots - 1))
    earlier = (slot < F.col("end")) | ((slot == F.col("end")) & F.coalesce(F.struct("rank", "size") < F.col("first_out"), F.lit(True)))
    # no end: the sample takes the whole source
    taken_once = F.when(~uncertain, (F.col("size") > 0) & (F.col("rest") > 0)).otherwise(F.col("end").isNull() | earlier)
    taken = F.col("size") * (F.col("copies") + F.coalesce(taken_once, F.lit(False)).cast("long"))
    return ended.select("row.*", "size", "source_size", "target", taken.alias("taken"))


SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    (CAST(('0x' || substr(md5('7-' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 12)) AS BIGINT) + 0.5::DOUBLE) / 281474976710656.0::DOUBLE AS u
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w FROM s),
f AS (
  SELECT *, CAST(coalesce(sum(source_size) OVER b, 0) AS BIGINT) * 2 AS full_before, CAST(sum(w) OVER () - coalesce(sum(w) OVER b, 0) AS BIGINT) AS w_left,
    CAST(sum(source_size) OVER () AS BIGINT) * 1.5::DOUBLE AS due
  FROM w WINDOW b AS (ORDER BY CAST(source_size AS DOUBLE) / w, encode(source) NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT max(CASE WHEN (due - full_before) / w_left * w <= source_size * 2 THEN (due - full_before) / w_left END) AS level FROM f),
t AS (SELECT source, source_size, coalesce(least(level * w, CAST(source_size * 2 AS DOUBLE)), CAST(source_size * 2 AS DOUBLE)) AS target FROM f, l),
p AS (
  SELECT d.doc_id, d.source, d.size, d.u, t.source_size, t.target,
    coalesce(CASE WHEN t.source_size > 0 THEN CAST(floor(t.target / t.source_size) AS BIGINT) END, 0) AS copies,
    coalesce(CASE WHEN t.source_size > 0 THEN t.target - floor(t.target / t.source_size) * t.source_size END, 0) AS rest
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
x AS (SELECT *, greatest(CAST(floor(sqrt(size)) AS BIGINT), 1) AS wt FROM p),
c AS (SELECT source, wt, CAST(sum(size) AS BIGINT) AS words, max(rest) AS rest FROM x WHERE size > 0 GROUP BY 1, 2),
lv AS (
  SELECT source, wt, lag(wt) OVER h AS above, CAST(coalesce(sum(words) OVER (h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS ahead,
    (rest - CAST(coalesce(sum(words) OVER (h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT)) / CAST(sum(wt * words) OVER (PARTITION BY source ORDER BY wt ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS level
  FROM c WINDOW h AS (PARTITION BY source ORDER BY wt DESC)),
lf AS (SELECT source, arg_max(level, wt) AS level, arg_max(coalesce(above, 1::BIGINT << 60), wt) AS certain_from, arg_max(ahead, wt) AS sure FROM lv WHERE level * wt <= 1 GROUP BY source),
o AS (
  SELECT x.*, wt >= certain_from AS certain, sure, (u / (1 - u)) / ((wt * level) / (1 - wt * level)) AS odds
  FROM x LEFT JOIN lf ON x.source IS NOT DISTINCT FROM lf.source),
r AS (
  SELECT *, coalesce(sum(CASE WHEN certain THEN 0 ELSE size END) OVER (PARTITION BY source ORDER BY certain DESC, odds / (1 + odds), size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead FROM o)
SELECT doc_id, size, source_size, target,
  CAST(size * (copies + CASE WHEN rest > 0 AND (certain OR ahead + size / 2.0::DOUBLE <= rest - sure) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM r
"""
