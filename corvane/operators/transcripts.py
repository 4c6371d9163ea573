"""From the lines of speaker logs to transcripts, in one pass over the logs, with counts of why lines were left out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from .stored import stored

REASONS = ("excluded source", "digit mode", "empty")
DIGITS = ("replaced", "missing", "mismatch", "skipped")


def is_digit_entry(source: Column) -> Column:
    """Whether a line's source marks a recording of a number; a missing source does not."""
    return F.coalesce(F.lower(F.trim(source)) == "random digit", F.lit(False))


def lone_digits(x: Column) -> Column:
    return F.regexp_extract_all(x, F.lit(r"\b([1-9])\b"), F.lit(1))


def cleaned(lines: DataFrame, digits: DataFrame, *, excluded: tuple[str, ...], digit_mode: str = "include", words: dict[int, str] | None = None) -> DataFrame:
    """Lines (file, source, text, ...) with `cleaned`, why a line is left out as `reason` (null if it is kept), and counts of lone digits by what became of them.

    Lines of an excluded source go first, then lines of numbers where `digit_mode` is "exclude", then those that cleaning leaves empty.
    Lone digits of lines of numbers become the saying that `digits` (file, digit, saying) has for the file: `replaced`, of which `mismatch` where
    the file's digit is another one; `missing` without an entry; `skipped` are those of other lines, which stay. A file's entry is
    one row; digits and their outcomes are counted only in lines that are cleaned.
    """
    if digit_mode not in ("include", "exclude"):
        raise ValueError("digit_mode is include or exclude")
    known = digits.select(F.col("file").alias("__file"), F.col("digit").cast("string").alias("__digit"), F.col("saying").alias("__saying"))
    rows = lines.join(known, F.col("file") == F.col("__file"), "left").drop("__file")
    entry = is_digit_entry(F.col("source"))
    first = F.when(tx.excluded_source(F.col("source"), excluded), REASONS[0])
    if digit_mode == "exclude":
        first = first.when(entry, REASONS[1])
    plain = tx.strip_parentheses(tx.strip_outer_quotes(F.trim(F.coalesce("text", F.lit("")))))
    rows = rows.withColumn("reason", first).withColumn("__plain", plain)
    found = F.when(F.col("reason").isNull(), lone_digits(F.col("__plain")))
    rows = rows.withColumn("__found", F.coalesce(found, F.array().cast("array<string>")))
    n, has = F.size("__found"), F.col("__saying").isNotNull()
    counts = {
        "replaced": F.when(entry & has, n).otherwise(0), "missing": F.when(entry & ~has, n).otherwise(0),
        "mismatch": F.when(entry & has, F.size(F.filter("__found", lambda d: d != F.col("__digit")))).otherwise(0), "skipped": F.when(~entry & (n > 0), 1).otherwise(0),
    }
    said = F.when(entry, tx.expand_single_digit(F.col("__plain"), F.col("__saying"))).otherwise(F.col("__plain"))
    rows = rows.withColumns(counts).withColumn("cleaned", tx.collapse_blanks(tx.expand_numbers(said, words or tx.number_words())))
    rows = rows.withColumn("reason", F.coalesce("reason", F.when(F.col("cleaned") == "", REASONS[2])))
    return rows.drop("__digit", "__saying", "__plain", "__found")


def pipeline(lines: DataFrame, digits: DataFrame, **how) -> tuple[DataFrame, DataFrame]:
    """(file, text) of the lines that are kept, with the lines' other columns; and one row of what was counted: `lines`, `written`, each reason, each outcome of a digit.

    The lines are read and cleaned once: what comes of them is written to the shared folder, and counts read its narrow columns.
    """
    rows = stored(cleaned(lines, digits, **how), "transcripts")
    name = lambda r: r.replace(" ", "_")
    counts = rows.agg(
        F.count("*").alias("lines"), F.count_if(F.col("reason").isNull()).alias("written"), *[F.count_if(F.col("reason").eqNullSafe(r)).alias(name(r)) for r in REASONS],
        *[F.coalesce(F.sum(d), F.lit(0)).alias(d) for d in DIGITS],
    )
    return rows.where("reason is null").drop("reason", "text", *DIGITS).withColumnRenamed("cleaned", "text"), counts
