"""The library's expressions as SQL functions and views of a session, for users who write SQL.

`register(spark)` defines temporary SQL functions; the optimizer sees through them, since their bodies are SQL. `result_views` puts a scored
table behind a view and defines table functions over it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .text import number_words


def _words() -> str:
    return "map(" + ", ".join(f"'{n}', '{w}'" for n, w in number_words().items()) + ")"


#: Name, parameters, type and body of each function.
FUNCTIONS = [
    ("strip_outer_quotes", "x STRING", "STRING", "CASE WHEN char_length(x) >= 2 AND startswith(x, '\"') AND endswith(x, '\"') THEN substring(x, 2, char_length(x) - 2) ELSE x END"),
    ("strip_parentheses", "x STRING", "STRING", r"regexp_replace(x, r'\s*\([^)]*\)', '')"),
    ("collapse_blanks", "x STRING", "STRING", r"trim(regexp_replace(x, r'\s+', ' '))"),
    ("number_words", "", "MAP<STRING, STRING>", _words()),
    # the text in runs of word characters and of others; runs that are a known number are looked up
    ("expand_numbers", "x STRING, words MAP<STRING, STRING>", "STRING", r"array_join(transform(regexp_extract_all(x, r'([\p{L}\p{N}_]+|[^\p{L}\p{N}_]+)', 1), w -> coalesce(try_element_at(words, w), w)), '')"),
    ("clean_transcript", "x STRING", "STRING", "collapse_blanks(expand_numbers(strip_parentheses(strip_outer_quotes(x)), number_words()))"),
    ("is_digit_entry", "source STRING", "BOOLEAN", "coalesce(lower(trim(source)) = 'random digit', false)"),
    ("excluded_source", "source STRING, prefixes ARRAY<STRING>", "BOOLEAN", "coalesce(exists(prefixes, p -> startswith(source, p)), false)"),
    ("duration_bucket", "x DOUBLE, edges ARRAY<DOUBLE>, names ARRAY<STRING>", "STRING", "CASE WHEN x IS NULL THEN element_at(names, -1) ELSE element_at(names, size(filter(edges, e -> e <= x)) + 1) END"),
    ("label_to_binary", "label STRING", "INT", "CASE lower(trim(label)) WHEN 'bonafide' THEN 1 WHEN 'spoof' THEN 0 WHEN '1' THEN 1 WHEN '1.0' THEN 1 WHEN '0' THEN 0 WHEN '0.0' THEN 0 ELSE CAST(raise_error(concat('unknown label: ', coalesce(lower(trim(label)), 'null'))) AS INT) END"),
    ("decibel", "x DOUBLE", "DOUBLE", "20 * log10(greatest(x, 1e-10D))"),
    ("shortcut_verdict", "rate DOUBLE", "STRING", "CASE WHEN rate >= 0.40 THEN 'CLEAN' WHEN rate >= 0.25 THEN 'MILD' WHEN rate >= 0.10 THEN 'SERIOUS' ELSE 'CRITICAL' END"),
    ("ratio_or_zero", "a DOUBLE, b DOUBLE", "DOUBLE", "coalesce(try_divide(a, b), 0D)"),
]


def register(spark: SparkSession) -> list[str]:
    """Defines the functions in the session, replacing those of the same names; their names."""
    for name, parameters, kind, body in FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {body}")
    return [f[0] for f in FUNCTIONS]


def result_views(spark: SparkSession, scored: DataFrame, system: str = "system", prefix: str = "result") -> None:
    """Views and table functions over a scored table (id, score, bona, system).

    `{prefix}_scored` is the table and `{prefix}_rates` each system's equal error rate against the genuine rows that all share;
    `{prefix}_confusion(threshold)` gives the counts of every system at a threshold, the genuine class positive.
    """
    from ..operators import det

    scored.createOrReplaceTempView(f"{prefix}_scored")
    det.system_eer(scored, system).createOrReplaceTempView(f"{prefix}_rates")
    spark.sql(f"""
        CREATE OR REPLACE TEMPORARY FUNCTION {prefix}_confusion(threshold DOUBLE) RETURNS TABLE (system STRING, tp BIGINT, fp BIGINT, tn BIGINT, fn BIGINT) RETURN
        WITH judged AS (SELECT `{system}` AS system, bona, score >= {prefix}_confusion.threshold AS accepted FROM {prefix}_scored),
          counts AS (SELECT system, bona, count_if(accepted) AS yes, count_if(NOT accepted) AS no FROM judged GROUP BY system, bona)
        SELECT s.system, coalesce(g.yes, 0), s.yes, s.no, coalesce(g.no, 0) FROM (SELECT * FROM counts WHERE NOT bona) s
        LEFT JOIN (SELECT sum(yes) AS yes, sum(no) AS no FROM counts WHERE bona) g ON true""")
