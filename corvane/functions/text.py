"""Transcript cleaning and number handling as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words for the numbers 10 to 100, built from units and tens.
_TEENS = ["ten", "eleven", "twelve", "thirteen", "fourteen", "fifteen", "sixteen", "seventeen", "eighteen", "nineteen"]
_UNITS = ["", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine"]
_TENS = ["twenty", "thirty", "forty", "fifty", "sixty", "seventy", "eighty", "ninety"]


def number_words() -> dict[int, str]:
    """Words by number, 10 to 100; another language's map can be passed wherever this one is used."""
    words = {10 + k: w for k, w in enumerate(_TEENS)}
    words |= {20 + 10 * t + u: f"{_TENS[t]} {_UNITS[u]}".strip() for t in range(8) for u in range(10)}
    return words | {100: "one hundred"}


def strip_outer_quotes(x: Column) -> Column:
    quoted = (F.char_length(x) >= 2) & x.startswith('"') & x.endswith('"')
    return F.when(quoted, F.substring(x, F.lit(2), F.char_length(x) - 2)).otherwise(x)


def strip_parentheses(x: Column) -> Column:
    return F.regexp_replace(x, r"\s*\([^)]*\)", "")


def collapse_blanks(x: Column) -> Column:
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def expand_numbers(x: Column, words: dict[int, str]) -> Column:
    """Every whole number of the map in words, wherever it stands between word borders: one pass over the text.

    The text is cut at its numbers; pieces of digits alone are looked up, others stay.
    """
    table = F.create_map(*[F.lit(v) for n, w in words.items() for v in (str(n), w)])
    pieces = F.split(x, r"(?<=\d)(?!\d)|(?<!\d)(?=\d)")
    at = F.transform(F.sequence(F.lit(0), F.size(pieces) - 1), lambda k: F.struct(
        F.get(pieces, k).alias("own"), F.coalesce(F.get(pieces, k - 1), F.lit("")).alias("before"), F.coalesce(F.get(pieces, k + 1), F.lit("")).alias("after")))
    free = lambda p: ~p["before"].rlike(r"[\p{L}\p{N}_]$") & ~p["after"].rlike(r"^[\p{L}\p{N}_]")
    return F.array_join(F.transform(at, lambda p: F.when(free(p), F.coalesce(F.try_element_at(table, p["own"]), p["own"])).otherwise(p["own"])), "")


def whole_numbers(x: Column) -> Column:
    """The numbers of a text that stand between word borders: the runs of word characters that are all digits."""
    return F.filter(F.regexp_extract_all(x, F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1)), lambda w: w.rlike("^[0-9]+$"))


def expand_single_digit(x: Column, saying: Column) -> Column:
    """Each lone digit 1-9 as the saying; texts without a saying stay."""
    safe = F.regexp_replace(saying, r"([\\$])", r"\\$1")
    return F.coalesce(F.regexp_replace(x, F.lit(r"\b[1-9]\b"), safe), x)


def digit_outcome(x: Column, digit: Column, saying: Column) -> Column:
    """What `expand_single_digit` comes to: `missing` without a saying, `mismatch` if another digit than the file's is there, else `replaced`; null without a lone digit."""
    digits = F.regexp_extract_all(x, F.lit(r"\b([1-9])\b"), F.lit(1))
    other = F.exists(digits, lambda d: ~d.eqNullSafe(digit.cast("string")))
    return F.when(F.size(digits) > 0, F.when(saying.isNull() | (saying == ""), "missing").when(other, "mismatch").otherwise("replaced"))


def clean(x: Column, saying: Column | None = None, words: dict[int, str] | None = None) -> Column:
    """Quotes, parentheses, digits, numbers, blanks, in this order."""
    x = strip_parentheses(strip_outer_quotes(x))
    if saying is not None:
        x = expand_single_digit(x, saying)
    return collapse_blanks(expand_numbers(x, words or number_words()))


def excluded_source(source: Column, prefixes: tuple[str, ...]) -> Column:
    """Whether a source starts with a prefix; a missing source is not excluded."""
    hit = F.lit(False)
    for p in prefixes:
        hit = hit | source.startswith(p)
    return F.coalesce(hit, F.lit(False))


def duration_bucket(x: Column, edges: tuple[float, ...], names: tuple[str, ...]) -> Column:
    """The name of the first edge that x is below, else the last name."""
    out = F.when(x < edges[0], names[0])
    for edge, name in zip(edges[1:], names[1:]):
        out = out.when(x < edge, name)
    return out.otherwise(names[-1])


def decibel(x: Column) -> Column:
    return 20 * F.log10(F.greatest(x, F.lit(1e-10)))
