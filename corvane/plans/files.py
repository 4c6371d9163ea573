"""Readers and sinks: files are made of the tables, written to the shared folder and read back by the library's readers."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.stored import stored
from ..session import shared_folder
from ..sources import logs, sinks, tables
from .catalogue import query


def _folder(spark, what: str) -> str:
    return f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex}"


def _table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _text(column: str) -> F.Column:
    return F.col(column).cast("string")


@query("read_predictions", "SELECT 'e,' || event_id AS id, (event_type = 'view')::INTEGER AS label, 100 - value AS s0, value AS s1, value - (100 - value) AS score FROM events")
def read_predictions(spark, sf_dir):
    """Ids with commas; every part file has the header."""
    e = _table(spark, sf_dir, "events")
    line = F.concat_ws(",", F.lit("e"), "event_id", (F.col("event_type") == "view").cast("int"), 100 - F.col("value"), "value")
    folder = _folder(spark, "predictions")
    # the writer's header line is the column's name
    e.select(line.alias("ID_audio,label,score_class0,score_class1")).write.option("header", True).option("quote", "").option("sep", "\t").csv(folder)
    return logs.predictions(spark, folder)


@query("read_predictions_csv", "SELECT event_id::VARCHAR AS id, (event_type = 'view')::INTEGER AS label, value AS score FROM events")
def read_predictions_csv(spark, sf_dir):
    e, folder = _table(spark, sf_dir, "events"), _folder(spark, "predictions")
    label = F.when(F.col("event_type") == "view", " Bonafide").when(F.col("event_id") % 2 == 0, "0").otherwise("SPOOF")
    e.select(label.alias("label"), F.col("value").alias("score_class1"), F.col("event_id").alias("ID_audio")).write.option("header", True).csv(folder)
    return tables.predictions_csv(spark, folder)


@query("read_manifest", "SELECT o_orderkey::VARCHAR AS ID, CASE o_orderkey % 4 WHEN 0 THEN 'val' WHEN 1 THEN 'test' ELSE 'train' END AS split, o_orderkey % 3 = 0 AS is_bonafide FROM orders")
def read_manifest(spark, sf_dir):
    key, folder = F.col("o_orderkey"), _folder(spark, "manifest")
    split = F.when(key % 4 == 0, "val").when(key % 4 == 1, "test").otherwise("train")
    rows = _table(spark, sf_dir, "orders").select(key.cast("string").alias("ID"), F.when(key % 3 == 0, "bonafide").otherwise("spoof").alias("label"), split.alias("split"))
    logs.write_manifest(rows, folder)
    return tables.manifest(spark, folder).select("ID", "split", "is_bonafide")


@query("read_speaker_list", "SELECT lpad(c_custkey::VARCHAR, 8, '0') AS speaker FROM customer")
def read_speaker_list(spark, sf_dir):
    """One file by its nature; every speaker stands twice."""
    c, folder = _table(spark, sf_dir, "customer"), _folder(spark, "speakers")
    rows = c.select(F.col("c_mktsegment").alias("segment"), F.lpad(_text("c_custkey"), 8, "0").alias("speaker_id"))
    rows.union(rows).coalesce(1).write.option("header", True).csv(folder)
    return tables.speaker_list(spark, folder).select("speaker")


@query("read_key_values", "SELECT c_custkey::VARCHAR AS key, c_name || ' - ' || c_mktsegment AS value FROM customer")
def read_key_values(spark, sf_dir):
    c, folder = _table(spark, sf_dir, "customer"), _folder(spark, "keys")
    sinks.append_key_values(c.select(_text("c_custkey").alias("key"), F.concat_ws(" - ", "c_name", "c_mktsegment").alias("value")), folder)
    return tables.key_values(spark, folder)


@query("read_tsv_targets", """SELECT s_suppkey::VARCHAR AS speaker, CASE WHEN s_suppkey % 5 <> 0 THEN s_suppkey || '.wav' WHEN s_suppkey % 10 = 0 THEN '' END AS file,
  CASE WHEN s_suppkey % 5 = 0 AND s_suppkey % 10 <> 0 THEN 'not four fields' WHEN s_suppkey % 10 = 0 THEN 'empty field' END AS error FROM supplier""")
def read_tsv_targets(spark, sf_dir):
    s, folder = _table(spark, sf_dir, "supplier"), _folder(spark, "targets")
    key = F.col("s_suppkey")
    line = F.when(key % 10 == 0, F.concat(_text("s_suppkey"), F.lit("\t\t"), "s_name", F.lit("\twhy"))).when(key % 5 == 0, _text("s_suppkey"))
    line = line.otherwise(F.concat(_text("s_suppkey"), F.lit("\t"), _text("s_suppkey"), F.lit(".wav\t"), "s_name", F.lit("\twhy")))
    s.select(line.alias("speaker\tfile\ttext\treason")).coalesce(1).write.option("header", True).option("quote", "").option("sep", "\x01").csv(folder)
    return tables.tsv_targets(spark, folder).select("speaker", "file", "error")


def _written(spark, rows: DataFrame, what: str) -> str:
    """The folder in which each row's `body` is a file at `path`."""
    folder = _folder(spark, what)
    stored(sinks.write_audio(rows.select("path", F.col("body").cast("binary").alias("content")), folder), "written")
    return folder


@query("read_transcripts", r"SELECT conv_id::VARCHAR AS speaker, turn || '.wav' AS file, md5(trim(regexp_replace(text, '\s', ' ', 'g'))) AS text_md5 FROM conversations WHERE trim(regexp_replace(text, '\s', ' ', 'g')) <> ''")
def read_transcripts(spark, sf_dir):
    """A file for each conversation, named after it."""
    c = _table(spark, sf_dir, "conversations")
    line = F.concat(_text("turn"), F.lit(".wav\t"), F.regexp_replace("text", r"\s", " "))
    files = c.select("conv_id", line.alias("line")).groupBy("conv_id").agg(F.array_join(F.collect_list("line"), "\n").alias("body"))
    folder = _written(spark, files.select(F.concat(_text("conv_id"), F.lit(".txt")).alias("path"), "body"), "transcripts")
    return tables.transcripts(spark, folder).select("speaker", "file", F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query("read_durations", "SELECT doc_id || '.wav' AS audio, n_chars / 16.0::DOUBLE AS duration_sec FROM documents")
def read_durations(spark, sf_dir):
    d, folder = _table(spark, sf_dir, "documents"), _folder(spark, "durations")
    sinks.write_report(d.select(F.concat(_text("doc_id"), F.lit(".wav")).alias("audio_filepath"), (F.col("n_chars") / 16).alias("duration_sec")), folder, "json")
    return tables.durations_jsonl(spark, folder)


@query("read_digit_map", "SELECT p_partkey || '.wav' AS file, (1 + p_partkey % 9)::VARCHAR AS digit, 'say ' || p_brand AS saying, CASE WHEN p_partkey % 7 = 0 THEN 1 ELSE 0 END::BIGINT AS conflicts FROM part")
def read_digit_map(spark, sf_dir):
    """A seventh of the files has a second line that says otherwise, further down the same file; blank sayings are skipped."""
    p, folder = _table(spark, sf_dir, "part"), _folder(spark, "digits")
    key = F.col("p_partkey")
    line = lambda digit, saying: F.struct(digit.alias("digit"), saying.alias("saying"))
    lines = F.array(line((1 + key % 9).cast("string"), F.concat(F.lit("say "), "p_brand")), line(F.lit("0"), F.lit("other")), line(F.lit("5"), F.lit(" ")))
    kept = F.filter(lines, lambda x, k: (k != 1) | (key % 7 == 0))
    rows = p.select(F.concat(_text("p_partkey"), F.lit(".wav")).alias("wav_filename"), F.explode(kept).alias("x")).select("wav_filename", "x.digit", "x.saying")
    sinks.write_report(rows, folder, "tsv")
    return tables.digit_map(spark, folder)


def _log_folder(spark, sf_dir) -> str:
    """Two logs for each even conversation, one for each odd one, with a header whose name is given twice."""
    c = _table(spark, sf_dir, "conversations").where("turn = 0")
    head = F.concat(F.lit('Speaker_Name = "first"\nSpeaker_Age="'), (20 + F.col("conv_id") % 60).cast("string"), F.lit('"\nOther = 1\n\nSpeaker_Name = '), "role", F.lit("\n"), _text("conv_id"), F.lit('.wav "src" "x = y"'))
    names = F.when(F.col("conv_id") % 2 == 0, F.array(F.lit("b.log"), F.lit("a.log"))).otherwise(F.array(F.lit("b.log")))
    files = c.select("conv_id", F.explode(names).alias("name"), head.alias("body"))
    return _written(spark, files.select(F.concat_ws("/", _text("conv_id"), "name").alias("path"), "body"), "logs")


@query("find_logs", "SELECT conv_id::VARCHAR AS speaker, CASE WHEN conv_id % 2 = 0 THEN 'a.log' ELSE 'b.log' END AS log, (2 - conv_id % 2)::BIGINT AS logs FROM conversations WHERE turn = 0")
def find_logs(spark, sf_dir):
    return tables.find_log(spark, _log_folder(spark, sf_dir)).select("speaker", F.regexp_extract("log", r"([^/]+)$", 1).alias("log"), "logs")


@query("log_headers", "SELECT conv_id::VARCHAR AS speaker, role AS name, (20 + conv_id % 60)::VARCHAR AS age, (2 - conv_id % 2)::BIGINT AS logs FROM conversations WHERE turn = 0")
def log_headers(spark, sf_dir):
    """The fields of every log; of a field given twice the last line wins."""
    lines = tables.numbered_lines(spark, _log_folder(spark, sf_dir))
    rows = logs.header_fields(lines, ["Speaker_Name", "Speaker_Age"])
    return rows.groupBy(F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("speaker"), F.col("Speaker_Name").alias("name"), F.col("Speaker_Age").alias("age")).agg(F.count("*").alias("logs"))


@query("disk_counts", "SELECT conv_id::VARCHAR AS folder, (2 - conv_id % 2)::BIGINT AS files FROM conversations WHERE turn = 0")
def disk_counts(spark, sf_dir):
    return logs.disk_counts(spark, _log_folder(spark, sf_dir), "*.log").select("folder", "files")


_L = r"""l AS (SELECT conv_id, turn, CASE WHEN turn % 5 = 1 THEN conv_id || '.' || turn || '.WAV "Random Digit" "' || (conv_id % 130) || '"' WHEN turn % 5 = 2 THEN conv_id || '.' || turn || '.wav = "' || role || '" "x"'
    WHEN turn % 5 = 3 THEN conv_id || '.wav' ELSE conv_id || '.' || turn || '.wav "' || role || '" "' || regexp_replace(text, '\s', ' ', 'g') || '"' END AS value FROM conversations)"""


def _grammar_lines(spark, sf_dir) -> DataFrame:
    c = _table(spark, sf_dir, "conversations")
    turn, name = F.col("turn"), F.concat_ws(".", "conv_id", "turn")
    value = F.when(turn % 5 == 1, F.concat(name, F.lit('.WAV "Random Digit" "'), (F.col("conv_id") % 130).cast("string"), F.lit('"'))).when(turn % 5 == 2, F.concat(name, F.lit('.wav = "'), "role", F.lit('" "x"')))
    value = value.when(turn % 5 == 3, F.concat(_text("conv_id"), F.lit(".wav"))).otherwise(F.concat(name, F.lit('.wav "'), "role", F.lit('" "'), F.regexp_replace("text", r"\s", " "), F.lit('"')))
    return c.select("conv_id", "turn", value.alias("value"))


@query("log_quote_split", f"WITH {_L}, s AS (SELECT *, string_split(value, '\"') AS p FROM l) SELECT conv_id, turn, trim(p[1]) AS file, trim(p[2]) AS source FROM s WHERE len(p) >= 3 AND ends_with(trim(p[1]), '.wav') AND NOT contains(p[1], '=')")
def log_quote_split(spark, sf_dir):
    return _grammar_lines(spark, sf_dir).select("conv_id", "turn", logs.quote_split(F.col("value")).alias("x")).where("x is not null").select("conv_id", "turn", "x.*")


@query("log_random_digits", f"WITH {_L}, s AS (SELECT *, string_split(value, '\"') AS p FROM l) SELECT conv_id, turn, trim(p[1]) AS file, trim(p[4])::INTEGER AS number FROM s WHERE len(p) >= 5 AND p[2] = 'Random Digit' AND try_cast(trim(p[4]) AS INTEGER) BETWEEN 10 AND 100")
def log_random_digits(spark, sf_dir):
    return _grammar_lines(spark, sf_dir).select("conv_id", "turn", logs.random_digits(F.col("value")).alias("x")).where("x is not null").select("conv_id", "turn", "x.*")


@query("log_any_audio", rf"""WITH {_L}, s AS (SELECT *, '(?i)^(.+?\.(wav|flac|mp3|ogg|m4a))\s+"[^"]+"\s+"(.*)"\s*$' AS g FROM l) SELECT conv_id, turn, regexp_extract(value, g, 1) AS file, md5(regexp_extract(value, g, 3)) AS text_md5 FROM s WHERE regexp_matches(value, g)""")
def log_any_audio(spark, sf_dir):
    rows = _grammar_lines(spark, sf_dir).select("conv_id", "turn", logs.any_audio(F.col("value")).alias("x")).where("x is not null")
    return rows.select("conv_id", "turn", "x.file", F.md5(F.col("x.text").cast("binary")).alias("text_md5"))


@query("first_and_last_wins", "SELECT user_id, arg_min(event_type, event_id) AS first, arg_max(event_type, event_id) AS last FROM events GROUP BY 1")
def first_and_last_wins(spark, sf_dir):
    e = _table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    one, other = logs.first_wins(e, ["user_id"], "event_id"), logs.last_wins(e, ["user_id"], "event_id")
    return one.select("user_id", F.col("event_type").alias("first")).join(other.select("user_id", F.col("event_type").alias("last")), "user_id")


@query("number_list", "SELECT value AS number, file, row_number() OVER (ORDER BY value, event_id) AS place FROM (SELECT event_id % 90 + 10 AS value, event_id, user_id || '.' || event_id || '.wav' AS file FROM events) t WHERE file NOT LIKE '%7.wav'")
def number_list(spark, sf_dir):
    """Numbers that are text in order of their value, then of their event; places are worked out range by range."""
    from ..operators.resample import numbered

    e = _table(spark, sf_dir, "events")
    text = (F.col("event_id") % 90 + 10).cast("string")
    rows = e.select(text.alias("number"), "event_id", F.concat_ws(".", "user_id", "event_id", F.lit("wav")).alias("file")).where("file not like '%7.wav'")
    # one key for all parts of the order, as wide as a number
    rows = numbered(rows.withColumn("key", F.col("number").cast("long") * (1 << 40) + F.col("event_id")).withColumn("all", F.lit(1)), ["all"], "key")
    return rows.select(F.col("number").cast("long").alias("number"), "file", (F.col("k") + 1).alias("place"))
