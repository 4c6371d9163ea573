"""Small tables beside a corpus: predictions, manifests, speaker lists, transcripts, maps, and the tree of audio files.

Everything is read through Spark with explicit schemas, so that ids keep their leading zeros. Lines that break a
table's rules are rows with `error` where the rules let them pass, and raise where they do not.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import logs
from .audio_headers import audio_headers

BOM = "\ufeff"


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, line, value): lines in the order in which Spark reads them, which within a file is the file's."""
    return logs.lines(spark, path).withColumn("line", F.monotonically_increasing_id()).withColumn("value", F.regexp_replace("value", f"^{BOM}|\r$", ""))


def name_and_path(argument: str) -> tuple[str, str]:
    """(name, path) of name=path, cut at the first sign; either one empty is an error."""
    name, sign, path = (x.strip() for x in argument.partition("="))
    if not (name and sign and path):
        raise ValueError(f"not name=path: {argument}")
    return name, path


def label_to_binary(label: Column) -> Column:
    """1 for bonafide, 0 for spoof, in any case and with blanks around; numbers as they are; anything else is an error."""
    text = F.lower(F.trim(label.cast("string")))
    number = text.try_cast("double").cast("int")
    wrong = F.raise_error(F.concat(F.lit("unknown label: "), F.coalesce(text, F.lit("null")))).cast("int")
    return F.when(text == "bonafide", 1).when(text == "spoof", 0).when(text.isin("0", "1", "0.0", "1.0"), number).otherwise(wrong)


def predictions_csv(spark: SparkSession, path: str) -> DataFrame:
    """(id, label, score) of a plain CSV with a header that names ID_audio, label and score_class1, in any order."""
    rows = spark.read.option("header", True).csv(path)
    if missing := {"ID_audio", "label", "score_class1"} - set(rows.columns):
        raise ValueError(f"missing columns: {', '.join(sorted(missing))}")
    return rows.select(F.col("ID_audio").alias("id"), label_to_binary(F.col("label")).alias("label"), F.col("score_class1").cast("double").alias("score"))


def manifest(spark: SparkSession, folder: str, label: str = "label") -> DataFrame:
    """Manifests of all splits, with labels 1 and 0 as `is_bonafide`; the split is the folder's column."""
    rows = logs.manifest_splits(spark, folder)
    return rows.withColumn("is_bonafide", label_to_binary(F.col(label)) == 1)


def speaker_list(spark: SparkSession, path: str, column: str = "speaker_id") -> DataFrame:
    """(speaker, place): the named column of a CSV, or its first one, each value once in the order of its first line."""
    lines = numbered_lines(spark, path)
    head = lines.orderBy("line").first()
    if head is None:
        return lines.select(F.col("value").alias("speaker"), F.col("line").alias("place"))
    names = [c.strip() for c in head["value"].split(",")]
    at = names.index(column) if column in names else 0
    ids = lines.where(F.col("line") != head["line"]).select(F.trim(F.get(F.split("value", ","), F.lit(at))).alias("speaker"), "line")
    return ids.where("speaker <> ''").groupBy("speaker").agg(F.min("line").alias("place"))


def key_values(spark: SparkSession, path: str, separator: str = " - ") -> DataFrame:
    """(key, value) lines; malformed ones are skipped and the last line of a key wins."""
    pairs = numbered_lines(spark, path).select(logs.key_value(F.col("value"), separator).alias("p"), "line").where("p is not null and p.key <> '' and p.value <> ''")
    return pairs.groupBy(F.col("p.key").alias("key")).agg(F.max_by("p.value", "line").alias("value"))


def tsv_targets(spark: SparkSession, path: str, names: tuple[str, str, str, str] = ("speaker", "file", "text", "reason")) -> DataFrame:
    """Four fields by tab after a header line, with `line` and `error`: rows of another width or with an empty field have one."""
    lines = numbered_lines(spark, path).where("trim(value) <> ''")
    head = lines.agg(F.min("line")).first()[0]
    parts = F.split("value", "\t")
    fields = [F.trim(F.get(parts, F.lit(k))).alias(n) for k, n in enumerate(names)]
    error = F.when(F.size(parts) != 4, "not four fields").when(F.exists(parts, lambda p: F.trim(p) == ""), "empty field")
    return lines.where(F.col("line") != (-1 if head is None else head)).select(*fields, "line", error.alias("error"))


def transcripts(spark: SparkSession, path: str) -> DataFrame:
    """(speaker, file, text) of transcript files named after their speaker; lines are cut at the first tab, empty texts go."""
    parts = F.split("value", "\t", 2)
    rows = logs.lines(spark, path).select(F.regexp_extract("path", r"([^/]+?)(\.[^./]*)?$", 1).alias("speaker"), F.trim(F.get(parts, F.lit(0))).alias("file"), F.trim(F.get(parts, F.lit(1))).alias("text"))
    return rows.where("file <> '' and text <> ''")


def durations_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """(audio, duration_sec) of a file of one JSON object a line; lines that are none have nulls."""
    return spark.read.schema("audio_filepath string, duration_sec double").json(path).select(F.col("audio_filepath").alias("audio"), "duration_sec")


def digit_map(spark: SparkSession, path: str) -> DataFrame:
    """(file, digit, saying, conflicts) of a TSV with those first three columns; the first line of a file wins, other sayings are counted."""
    rows = spark.read.option("header", True).option("sep", "\t").csv(path)
    wanted = ("wav_filename", "digit", "saying")
    if missing := set(wanted) - set(rows.columns):
        raise ValueError(f"missing columns: {', '.join(sorted(missing))}")
    rows = rows.select(*[F.trim(c).alias(c) for c in wanted], F.monotonically_increasing_id().alias("line")).where("wav_filename <> '' and digit <> '' and saying <> ''")
    first = F.min_by(F.struct("digit", "saying"), "line")
    out = rows.groupBy(F.col("wav_filename").alias("file")).agg(first.alias("first"), (F.countDistinct("digit", "saying") - 1).alias("conflicts"))
    return out.select("file", "first.digit", "first.saying", "conflicts")


def number_map(spark: SparkSession, path: str) -> dict[int, str]:
    """A JSON object of numbers and words, as `functions.text.expand_numbers` takes it; anything but an object is an error."""
    whole = "\n".join(r[0] for r in spark.read.option("wholetext", True).text(path).collect())
    parsed = spark.range(1).select(F.from_json(F.lit(whole), "map<string,string>").alias("m")).first()["m"]
    if not parsed:
        raise ValueError(f"no JSON object of numbers: {path}")
    return {int(k): v for k, v in parsed.items()}


def find_log(spark: SparkSession, folder: str) -> DataFrame:
    """(speaker, log, logs): by folder, the log that sorts first and how many there are."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.log").load(folder)
    return files.groupBy(F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("speaker")).agg(F.min("path").alias("log"), F.count("*").alias("logs"))


def audio_tree(spark: SparkSession, root: str, label: str, method: str = "none", most_per_speaker: int | None = None, extensions: tuple[str, ...] = ("wav", "flac")) -> DataFrame:
    """(id, path, label, speaker_id, spoof_method) of the audio files under root/<speaker>/, the first by path of each speaker where that is capped.

    A missing root warns and is empty.
    """
    if not _exists(spark, root):
        warnings.warn(f"no folder to read: {root}", stacklevel=2)
        return spark.createDataFrame([], "id string, path string, label string, speaker_id string, spoof_method string")
    base = root.rstrip("/").removeprefix("file://")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path")
    below = F.regexp_extract("path", "^[^:]*:/*(/.*)$", 1)
    below = F.when(below == "", F.col("path")).otherwise(below)
    rows = files.withColumn("__below", F.substring(below, F.lit(len(base) + 2), F.char_length("path"))).where(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*extensions))
    rows = rows.select(
        F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1).alias("id"), "path", F.lit(label).alias("label"),
        F.get(F.split("__below", "/"), F.lit(0)).alias("speaker_id"), F.lit(method).alias("spoof_method"),
    )
    if most_per_speaker is None:
        return rows
    # the planner keeps only the first of each speaker before it shuffles
    place = F.row_number().over(Window.partitionBy("speaker_id").orderBy("path"))
    return rows.withColumn("__place", place).where(F.col("__place") <= most_per_speaker).drop("__place")


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def audio_inventory(spark: SparkSession, root: str, label: str = "bonafide", method: str = "none") -> DataFrame:
    """The tree's files with `duration_sec`, `sample_rate`, `channels`, `subtype`, `container`, `valid` and `error`, from headers alone; unreadable files are rows with an error."""
    rows = audio_headers(spark, root)
    return rows.select(
        "id", "path", F.lit(label).alias("label"), "speaker_id", F.lit(method).alias("spoof_method"), "duration_sec", "sample_rate", "channels", "subtype", "container", "valid", "error"
    )
