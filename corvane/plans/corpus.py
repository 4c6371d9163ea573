"""Corpus queries: sources, durations, logs and transcripts.

Documents stand for clips, with their length in characters as duration; turns of conversations stand for log
lines, `conv.turn.wav "role" "text"`, blanks for line ends.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import audit, selection, transcripts
from ..sources import logs
from .catalogue import query


def documents(spark, sf_dir) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "lang", "n_chars")


@query("source_audit", "SELECT source, count(*) AS clips, count(DISTINCT lang) AS langs, sum(n_chars)::BIGINT AS total, round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (), 6) AS share FROM documents GROUP BY source")
def source_audit(spark, sf_dir):
    return audit.by_source(documents(spark, sf_dir), "source", "lang", "n_chars")


@query("inventory_extremes", "WITH g AS (SELECT source, count(*) AS clips, sum(n_chars)::BIGINT AS total FROM documents GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY total, source) AS a, row_number() OVER (ORDER BY total DESC, source) AS b FROM g) SELECT 'fewest' AS side, a AS place, source, clips, total FROM r WHERE a <= 5 UNION ALL SELECT 'most', b, source, clips, total FROM r WHERE b <= 5")
def inventory_extremes(spark, sf_dir):
    return audit.extremes(documents(spark, sf_dir), "source", "n_chars", 5)


_BUCKET = "CASE WHEN n_chars < 500 THEN 'under 500' WHEN n_chars < 1500 THEN '500 to 1500' WHEN n_chars < 5000 THEN '1500 to 5000' ELSE 'from 5000' END"


@query("duration_buckets", f"SELECT lang, {_BUCKET} AS bucket, count(*) AS clips FROM documents GROUP BY 1, 2")
def duration_buckets(spark, sf_dir):
    bucket = tx.duration_bucket(F.col("n_chars"), (500, 1500, 5000), ("under 500", "500 to 1500", "1500 to 5000", "from 5000"))
    return documents(spark, sf_dir).groupBy("lang", bucket.alias("bucket")).agg(F.count("*").alias("clips"))


@query("duration_rollup", "SELECT source, count(*) AS clips, round(sum(n_chars)::DOUBLE / count(*), 6) AS mean, min(n_chars) AS shortest, max(n_chars) AS longest, round(100.0::DOUBLE * count(*) FILTER (n_chars < 500) / count(*), 6) AS short_share FROM documents GROUP BY ROLLUP (source)")
def duration_rollup(spark, sf_dir):
    rows = documents(spark, sf_dir).rollup("source")
    return rows.agg(
        F.count("*").alias("clips"), F.round(F.sum("n_chars") / F.count("*"), 6).alias("mean"), F.min("n_chars").alias("shortest"), F.max("n_chars").alias("longest"),
        F.round(F.lit(100.0) * F.count_if(F.col("n_chars") < 500) / F.count("*"), 6).alias("short_share"),
    )


@query("level_spread", "WITH g AS (SELECT source, sum(n_chars)::DOUBLE / count(*) AS mean FROM documents GROUP BY 1) SELECT count(*) AS sources, round(stddev_pop(mean), 4) AS spread, stddev_pop(mean) < 0.5 AS ok FROM g")
def level_spread(spark, sf_dir):
    """Population deviation of the sources' means."""
    means = documents(spark, sf_dir).groupBy("source").agg((F.sum("n_chars") / F.count("*")).alias("mean"))
    return means.agg(F.count("*").alias("sources"), F.round(F.stddev_pop("mean"), 4).alias("spread"), (F.stddev_pop("mean") < 0.5).alias("ok"))


@query("silence_stats", "SELECT lang, round(sum(n_chars)::DOUBLE / count(*), 6) AS mean, median(n_chars)::DOUBLE AS middle, min(n_chars) AS least, max(n_chars) AS most, round(stddev_pop(n_chars), 4) AS deviation, count(*) FILTER (n_chars < 50) AS below FROM documents GROUP BY 1")
def silence_stats(spark, sf_dir):
    n = F.col("n_chars")
    docs = documents(spark, sf_dir)
    out = docs.groupBy("lang").agg(
        F.round(F.sum(n) / F.count("*"), 6).alias("mean"), F.min(n).alias("least"), F.max(n).alias("most"),
        F.round(F.stddev_pop(n), 4).alias("deviation"), F.count_if(n < 50).alias("below"),
    )
    middle = selection.percentiles(docs, ["lang"], "n_chars", {"middle": 0.5}).withColumnRenamed("lang", "of")
    return out.join(middle, F.col("lang").eqNullSafe(F.col("of")), "left").drop("of")


_X = "x AS (SELECT d.lang AS value, l.quality AS y, count(*) AS n FROM documents d JOIN labels l USING (doc_id) GROUP BY 1, 2), c AS (SELECT value, coalesce(sum(n) FILTER (y = 0), 0)::BIGINT AS class_0, coalesce(sum(n) FILTER (y = 1), 0)::BIGINT AS class_1 FROM x GROUP BY 1)"


@query("provenance_crosstab", f"WITH {_X} SELECT value, class_0, class_1, (SELECT count(*) FROM c) > 1 AND greatest(class_0, class_1)::DOUBLE / (class_0 + class_1) > 0.95 AS lopsided FROM c")
def provenance_crosstab(spark, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    return audit.crosstab(documents(spark, sf_dir).join(labels, "doc_id"), "lang", "quality")


def log_table(spark, sf_dir) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    flat = F.regexp_replace("text", r"\s", " ")
    return c.select("conv_id", "turn", F.concat(F.col("conv_id").cast("string"), F.lit("."), F.col("turn").cast("string"), F.lit('.wav "'), "role", F.lit('" "'), flat, F.lit('"')).alias("value"))


_G = r"""g AS (SELECT conv_id, turn, conv_id || '.' || turn || '.wav "' || role || '" "' || regexp_replace(text, '\s', ' ', 'g') || '"' AS value FROM conversations),
  u AS (SELECT conv_id, turn, regexp_extract(value, '^(\S+\.wav)\s+"([^"]*)"\s+(.*)$', 1) AS file, regexp_extract(value, '^(\S+\.wav)\s+"([^"]*)"\s+(.*)$', 2) AS source, regexp_extract(value, '^(\S+\.wav)\s+"([^"]*)"\s+(.*)$', 3) AS text
    FROM g WHERE regexp_matches(value, '^(\S+\.wav)\s+"([^"]*)"\s+(.*)$') AND NOT (contains(value, '=') AND NOT starts_with(value, '"')))"""


def utterances(spark, sf_dir) -> DataFrame:
    u = logs.utterances(F.col("value"))
    return log_table(spark, sf_dir).select("conv_id", "turn", u.alias("u")).where("u is not null").select("conv_id", "turn", "u.*")


@query("log_lines", f"WITH {_G} SELECT conv_id, turn, file, source, md5(text) AS text_md5 FROM u")
def log_lines(spark, sf_dir):
    return utterances(spark, sf_dir).select("conv_id", "turn", "file", "source", F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query(
    "log_lines_sql",
    r"""WITH g AS (SELECT conv_id, turn * 10 AS line, CASE turn % 4 WHEN 3 THEN 'no line of a log: ' || role ELSE conv_id || '.' || turn || '.wav "' || role || '" "' || regexp_replace(text, '\s', ' ', 'g') || '"' END AS value FROM conversations
      UNION ALL SELECT conv_id, 1, 'Speaker = "' || role || '"' FROM conversations WHERE turn = 0 UNION ALL SELECT conv_id, 2, '  ' FROM conversations WHERE turn = 0),
    k AS (SELECT *, contains(value, '=') AND NOT starts_with(value, '"') AS head, '^(\S+\.wav)\s+"([^"]*)"\s+(.*)$' AS p, '^\s*([^=]+?)\s*=\s*"?(.*?)"?\s*$' AS h FROM g WHERE trim(value) <> ''),
    r AS (SELECT *, CASE WHEN head AND regexp_matches(value, h) THEN 'header' WHEN NOT head AND regexp_matches(value, p) THEN 'utterance' ELSE 'bad' END AS kind FROM k)
    SELECT conv_id::VARCHAR AS log, line, kind, CASE kind WHEN 'utterance' THEN regexp_extract(value, p, 1) WHEN 'header' THEN regexp_extract(value, h, 1) END AS file,
      CASE kind WHEN 'utterance' THEN regexp_extract(value, p, 2) END AS source, md5(CASE kind WHEN 'utterance' THEN regexp_extract(value, p, 3) WHEN 'header' THEN regexp_extract(value, h, 2) ELSE value END) AS text_md5 FROM r""",
)
def log_lines_sql(spark, sf_dir):
    """Logs with headers, blank and bad lines, read in SQL by the table function."""
    from ..sources import log_function

    log_function.register(spark)
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return spark.sql(
        r"""WITH lines AS (
          SELECT CAST(conv_id AS STRING) AS log, turn * 10 AS line,
            CASE turn % 4 WHEN 3 THEN concat('no line of a log: ', role) ELSE concat(conv_id, '.', turn, '.wav "', role, '" "', regexp_replace(text, '\\s', ' '), '"') END AS value FROM {c}
          UNION ALL SELECT CAST(conv_id AS STRING), inline(array(struct(1L, concat('Speaker = "', role, '"')), struct(2L, '  '))) FROM {c} WHERE turn = 0)
        SELECT log, line, kind, file, source, md5(text) AS text_md5 FROM log_lines(TABLE(SELECT log, line, value FROM lines))""",
        c=c,
    )


_WORDS = "map {" + ", ".join(f"'{n}': '{w}'" for n, w in tx.number_words().items()) + "}"
#: The lines of a corpus with digits, numbers, excluded sources, glosses and lines that come out empty, made from the turns.
_CORPUS = r"""w AS (SELECT conv_id, turn, conv_id || '.' || turn || '.wav' AS file, CASE WHEN turn % 5 = 2 THEN ' Random Digit' WHEN turn % 7 = 3 THEN 'TGL_' || role ELSE role END AS source,
    CASE WHEN turn % 5 = 2 THEN '"' || (1 + conv_id % 9) || ' (one)"' WHEN turn % 11 = 4 THEN '"(' || role || ')"' ELSE '"' || regexp_replace(text, '\s', ' ', 'g') || ' ' || (conv_id % 120) || ' (gloss) ' || (1 + turn % 9) || '"' END AS text FROM conversations),
  dm AS (SELECT conv_id || '.' || turn || '.wav' AS file, CASE WHEN conv_id % 4 = 0 THEN '9' ELSE (1 + conv_id % 9)::VARCHAR END AS digit, 'say ' || conv_id % 9 AS saying FROM conversations WHERE conv_id % 3 <> 0)"""
_CLEANED = rf"""{_CORPUS}, q AS (SELECT *, lower(trim(source)) = 'random digit' AS entry, CASE WHEN length(text) >= 2 AND starts_with(text, '"') AND ends_with(text, '"') THEN substr(text, 2, length(text) - 2) ELSE text END AS t1 FROM w),
  p AS (SELECT q.*, digit, saying, regexp_replace(t1, '\s*\([^)]*\)', '', 'g') AS plain FROM q LEFT JOIN dm USING (file)),
  x AS (SELECT *, CASE WHEN entry AND saying IS NOT NULL THEN regexp_replace(plain, '\b[1-9]\b', saying, 'g') ELSE plain END AS said, regexp_extract_all(plain, '\b([1-9])\b', 1) AS found FROM p),
  y AS (SELECT *, trim(regexp_replace(array_to_string(list_transform(regexp_extract_all(said, '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_]+'), lambda w: coalesce({_WORDS}[w], w)), ''), '\s+', ' ', 'g')) AS cleaned FROM x),
  z AS (SELECT *, CASE WHEN starts_with(source, 'TGL_') THEN 'excluded source' WHEN cleaned = '' THEN 'empty' END AS reason FROM y)"""


def corpus_lines(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """((conv_id, turn, file, source, text), the digit map)"""
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    conv, turn, text = F.col("conv_id"), F.col("turn"), F.regexp_replace("text", r"\s", " ")
    number = lambda x: x.cast("string")
    file = F.concat(number(conv), F.lit("."), number(turn), F.lit(".wav"))
    source = F.when(turn % 5 == 2, " Random Digit").when(turn % 7 == 3, F.concat(F.lit("TGL_"), "role")).otherwise(F.col("role"))
    said = F.when(turn % 5 == 2, F.concat(F.lit('"'), number(1 + conv % 9), F.lit(' (one)"'))).when(turn % 11 == 4, F.concat(F.lit('"('), "role", F.lit(')"')))
    said = said.otherwise(F.concat(F.lit('"'), text, F.lit(" "), number(conv % 120), F.lit(" (gloss) "), number(1 + turn % 9), F.lit('"')))
    digits = c.where("conv_id % 3 <> 0").select(file.alias("file"), F.when(conv % 4 == 0, "9").otherwise(number(1 + conv % 9)).alias("digit"), F.concat(F.lit("say "), number(conv % 9)).alias("saying"))
    return c.select("conv_id", "turn", file.alias("file"), source.alias("source"), said.alias("text")), digits


@query("transcript_clean", f"WITH {_CLEANED} SELECT conv_id, turn, file, md5(cleaned) AS cleaned_md5, length(cleaned) AS length FROM z WHERE reason IS NULL")
def transcript_clean(spark, sf_dir):
    """All lines through the whole chain, digits and numbers in words; those that are kept."""
    lines, digits = corpus_lines(spark, sf_dir)
    kept = transcripts.cleaned(lines, digits, excluded=("TGL_",)).where("reason is null")
    return kept.select("conv_id", "turn", "file", F.md5(F.col("cleaned").cast("binary")).alias("cleaned_md5"), F.char_length("cleaned").cast("long").alias("length"))


@query("transcript_digits", f"""WITH {_CLEANED}, c AS (SELECT source, entry, CASE WHEN reason IS DISTINCT FROM 'excluded source' THEN found ELSE [] END AS f, saying, digit FROM z)
  SELECT trim(source) AS source, sum(CASE WHEN entry AND saying IS NOT NULL THEN len(f) ELSE 0 END)::BIGINT AS replaced, sum(CASE WHEN entry AND saying IS NULL THEN len(f) ELSE 0 END)::BIGINT AS missing,
    sum(CASE WHEN entry AND saying IS NOT NULL THEN len(list_filter(f, lambda d: d <> digit)) ELSE 0 END)::BIGINT AS mismatch, sum(CASE WHEN NOT entry AND len(f) > 0 THEN 1 ELSE 0 END)::BIGINT AS skipped FROM c GROUP BY 1""")
def transcript_digits(spark, sf_dir):
    """What became of lone digits, by source."""
    lines, digits = corpus_lines(spark, sf_dir)
    rows = transcripts.cleaned(lines, digits, excluded=("TGL_",))
    return rows.groupBy(F.trim("source").alias("source")).agg(*[F.sum(d).cast("long").alias(d) for d in transcripts.DIGITS])


@query("expand_numbers", rf"""WITH w AS (SELECT doc_id, array_to_string(list_transform(regexp_extract_all(text, '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_]+'), lambda w: coalesce({_WORDS}[w], w)), '') AS t FROM documents WHERE text IS NOT NULL) SELECT doc_id, md5(t) AS text_md5 FROM w""")
def expand_numbers(spark, sf_dir):
    """Texts with their numbers from 10 to 100 in words."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").where("text is not null")
    return d.select("doc_id", F.md5(tx.expand_numbers(F.col("text"), tx.number_words()).cast("binary")).alias("text_md5"))


_REASON = "CASE WHEN starts_with(source, 'TGL_') THEN 'excluded source' WHEN entry THEN 'digit mode' WHEN cleaned = '' THEN 'empty' ELSE 'kept' END"


@query("transcript_reasons", f"WITH {_CLEANED} SELECT {_REASON} AS reason, count(*) AS lines FROM z GROUP BY 1")
def transcript_reasons(spark, sf_dir):
    """Why lines are left out, the first reason that holds, where lines of numbers are not wanted."""
    lines, digits = corpus_lines(spark, sf_dir)
    rows = transcripts.cleaned(lines, digits, excluded=("TGL_",), digit_mode="exclude")
    return rows.groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("lines"))


@query("find_numbers_in_lines", rf"WITH {_CORPUS} SELECT file, array_to_string(regexp_extract_all(text, '\d+'), ',') AS numbers FROM w WHERE lower(trim(source)) <> 'random digit' AND regexp_matches(text, '\d')")
def find_numbers_in_lines(spark, sf_dir):
    """The numbers of the lines that are not recordings of numbers."""
    lines, _ = corpus_lines(spark, sf_dir)
    rows = lines.where(~transcripts.is_digit_entry(F.col("source")) & F.col("text").rlike(r"\d"))
    return rows.select("file", F.array_join(F.regexp_extract_all("text", F.lit(r"(\d+)"), F.lit(1)), ",").alias("numbers"))


@query("find_numbers", r"SELECT doc_id, array_to_string(regexp_extract_all(text, '\d+'), ',') AS numbers FROM documents WHERE regexp_matches(text, '\d')")
def find_numbers(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").where(F.col("text").rlike(r"\d"))
    return d.select("doc_id", F.array_join(F.regexp_extract_all("text", F.lit(r"(\d+)"), F.lit(1)), ",").alias("numbers"))


_NUM = r"list_filter(regexp_extract_all(text, '[\p{L}\p{N}_]+'), lambda w: regexp_full_match(w, '[0-9]+'))"


@query("detect_numbers_explode", f"WITH e AS (SELECT doc_id, unnest({_NUM}) AS n, generate_subscripts({_NUM}, 1) AS place FROM documents) SELECT doc_id, place::BIGINT AS place, n::INTEGER AS number FROM e WHERE length(n) <= 3 AND NOT starts_with(n, '0') AND n::BIGINT BETWEEN 10 AND 100")
def detect_numbers_explode(spark, sf_dir):
    """One row for each number of the word map that stands between word borders, with its place among such numbers."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = d.select("doc_id", F.posexplode(tx.whole_numbers(F.col("text"))).alias("place", "n"))
    known = [str(n) for n in tx.number_words()]
    return rows.where(F.col("n").isin(known)).select("doc_id", (F.col("place") + 1).cast("long").alias("place"), F.col("n").cast("int").alias("number"))


@query("char_stats", "WITH g AS (SELECT conv_id, count(*) AS turns, sum(length(text))::BIGINT AS chars FROM conversations GROUP BY 1) SELECT conv_id, turns, chars, round(chars::DOUBLE / turns, 6) AS mean FROM g ORDER BY chars DESC, conv_id LIMIT 10")
def char_stats(spark, sf_dir):
    """The ten logs with most characters."""
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet").groupBy("conv_id").agg(F.count("*").alias("turns"), F.sum(F.char_length("text")).alias("chars"))
    return c.withColumn("mean", F.round(F.col("chars") / F.col("turns"), 6)).orderBy(F.desc("chars"), "conv_id").limit(10)


_T = "SELECT conv_id, turn FROM conversations WHERE role = 'user'"


@query("missing_generation", f"WITH t AS ({_T}), o AS (SELECT conv_id, turn - 1 AS turn FROM conversations WHERE role = 'assistant'), f AS (SELECT conv_id, turn FROM t WHERE turn = 0) SELECT conv_id, turn FROM t WHERE (conv_id, turn) NOT IN (SELECT conv_id, turn FROM o) AND (conv_id, turn) NOT IN (SELECT conv_id, turn FROM f) AND conv_id IN (SELECT conv_id FROM o)")
def missing_generation(spark, sf_dir):
    """User turns without an answer, less the first turns, in conversations that have an answer at all."""
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role")
    done = c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"))
    asked = c.where("role = 'user'").select("conv_id", "turn")
    return audit.missing(asked, done, asked.where("turn = 0"), ["conv_id", "turn"], "conv_id")


@query("worklist", "WITH r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM documents WHERE source IN ('src0', 'src1', 'src2', 'src3')) SELECT doc_id, source FROM r WHERE rn <= 20 AND doc_id NOT IN (SELECT doc_id FROM labels)")
def worklist(spark, sf_dir):
    """The first twenty of each chosen source, less those that are done."""
    chosen = documents(spark, sf_dir).where(F.col("source").isin("src0", "src1", "src2", "src3")).select("doc_id", "source")
    done = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id")
    return audit.worklist(chosen, done, "source", "doc_id", 20)


@query("leak_crosscheck", "SELECT source, count(*) AS leaked FROM documents WHERE starts_with(source, 'src1') AND doc_id IN (SELECT doc_id FROM labels) GROUP BY 1")
def leak_crosscheck(spark, sf_dir):
    """Rows of excluded sources among what was processed."""
    bad = documents(spark, sf_dir).where(tx.excluded_source(F.col("source"), ("src1",)))
    return bad.join(spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id"), "doc_id", "left_semi").groupBy("source").agg(F.count("*").alias("leaked"))


_CFG = """n AS (SELECT n_nationkey, r_name || '.' || n_name AS key FROM nation JOIN region ON r_regionkey = n_regionkey),
  a AS (SELECT key, min(c_mktsegment) AS left_value FROM customer JOIN n ON n_nationkey = c_nationkey WHERE c_custkey % 7 = 0 GROUP BY 1),
  b AS (SELECT key, max(c_mktsegment) AS right_value FROM customer JOIN n ON n_nationkey = c_nationkey WHERE c_custkey % 11 = 0 GROUP BY 1)"""


@query("config_diff", f"WITH {_CFG} SELECT key, coalesce(left_value, '<absent>') AS left_value, coalesce(right_value, '<absent>') AS right_value, starts_with(key, 'ASIA') OR starts_with(key, 'EUROPE.F') AS allowed FROM a FULL JOIN b USING (key) WHERE left_value IS DISTINCT FROM right_value")
def config_diff(spark, sf_dir):
    """What differs between two configurations, of dotted keys by region and nation, and whether it may."""
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    nations = read("nation").join(read("region"), F.col("r_regionkey") == F.col("n_regionkey")).select("n_nationkey", F.concat_ws(".", "r_name", "n_name").alias("key"))
    rows = read("customer").join(nations, F.col("n_nationkey") == F.col("c_nationkey"))
    left = rows.where("c_custkey % 7 = 0").groupBy("key").agg(F.min("c_mktsegment").alias("value"))
    right = rows.where("c_custkey % 11 = 0").groupBy("key").agg(F.max("c_mktsegment").alias("value"))
    return audit.rows_diff(left, right, ("ASIA", "EUROPE.F"))
