"""Queries written in SQL, with the library's functions and views."""

from __future__ import annotations

from ..functions import sql
from .catalogue import query
from .corpus import _BUCKET, _CORPUS, _WORDS, corpus_lines
from .detector import _E, _POOL, _eer, scored


@query(
    "sql_cleaned",
    rf"""WITH {_CORPUS}, q AS (SELECT *, regexp_replace(CASE WHEN length(text) >= 2 AND starts_with(text, '"') AND ends_with(text, '"') THEN substr(text, 2, length(text) - 2) ELSE text END, '\s*\([^)]*\)', '', 'g') AS t FROM w)
    SELECT file, lower(trim(source)) = 'random digit' AS digits, md5(trim(regexp_replace(array_to_string(list_transform(regexp_extract_all(t, '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_]+'),
      lambda w: coalesce({_WORDS}[w], w)), ''), '\s+', ' ', 'g'))) AS cleaned_md5 FROM q WHERE NOT starts_with(source, 'TGL_') AND NOT starts_with(source, 'sys')""",
)
def sql_cleaned(spark, sf_dir):
    sql.register(spark)
    lines, _ = corpus_lines(spark, sf_dir)
    return spark.sql("SELECT file, is_digit_entry(source) AS digits, md5(clean_transcript(text)) AS cleaned_md5 FROM {lines} WHERE NOT excluded_source(source, array('TGL_', 'sys'))", lines=lines)


@query("sql_buckets", f"SELECT lang, {_BUCKET} AS bucket, count(*) AS clips, round(20 * log10(avg(n_chars)), 6) AS level FROM documents GROUP BY 1, 2")
def sql_buckets(spark, sf_dir):
    sql.register(spark)
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return spark.sql(
        """SELECT lang, bucket, clips, round(decibel(mean), 6) AS level FROM (
          SELECT lang, duration_bucket(n_chars, array(500D, 1500D, 5000D), array('under 500', '500 to 1500', '1500 to 5000', 'from 5000')) AS bucket, count(*) AS clips, avg(n_chars) AS mean FROM {documents} GROUP BY ALL)""",
        documents=documents,
    )


@query(
    "sql_results",
    f"""WITH {_E}, {_POOL}, {_eer('p', 'g', 'r')}, c AS (SELECT g, count(*) FILTER (score >= 50 AND bona) AS tp, count(*) FILTER (score >= 50 AND NOT bona) AS fp, count(*) FILTER (score < 50 AND NOT bona) AS tn, count(*) FILTER (score < 50 AND bona) AS fn FROM p GROUP BY g)
    SELECT g AS system, round(eer, 9) AS eer, CASE WHEN eer >= 0.40 THEN 'CLEAN' WHEN eer >= 0.25 THEN 'MILD' WHEN eer >= 0.10 THEN 'SERIOUS' ELSE 'CRITICAL' END AS verdict, tp, fp, tn, fn,
      round(tp::DOUBLE / (tp + fp), 9) AS bona_precision FROM r JOIN c USING (g)""",
)
def sql_results(spark, sf_dir):
    """Every system's rate and verdict beside its counts at a threshold of 50."""
    sql.register(spark)
    sql.result_views(spark, scored(spark, sf_dir).select("id", "score", "bona", "system"))
    return spark.sql(
        """SELECT r.system, round(r.eer, 9) AS eer, shortcut_verdict(r.eer) AS verdict, c.tp, c.fp, c.tn, c.fn, round(ratio_or_zero(c.tp, c.tp + c.fp), 9) AS bona_precision
        FROM result_rates r JOIN result_confusion(50D) c USING (system)"""
    )
