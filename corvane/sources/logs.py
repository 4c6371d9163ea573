"""Speaker logs and other line formats as DataFrames; all read through Spark, all with explicit schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# The line grammars.
HEADER = r'^\s*([^=]+?)\s*=\s*"?(.*?)"?\s*$'
LINE = r'^(\S+\.wav)\s+"([^"]*)"\s+(.*)$'
AUDIO = r'(?i)^(.+?\.(wav|flac|mp3|ogg|m4a))\s+"[^"]+"\s+"(.*)"\s*$'
PREDICTION = r"^(.*),([^,]*),([^,]*),([^,]*)$"


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, value) of text files, found recursively."""
    return spark.read.option("recursiveFileLookup", True).text(path).select(F.col("_metadata.file_path").alias("path"), "value")


def header_fields(frame: DataFrame, wanted: list[str], by: str = "path", order: str = "line") -> DataFrame:
    """One row per log with the wanted `key = "value"` fields, quotes optional; of a field given twice the last line by `order` wins."""
    key = F.regexp_extract("value", HEADER, 1)
    found = frame.where(key.isin(wanted)).select(by, order, key.alias("k"), F.regexp_extract("value", HEADER, 2).alias("v"))
    return found.groupBy(by).pivot("k", wanted).agg(F.max_by("v", order))


def utterances(value: Column, skip_eq: bool = True) -> Column:
    """(file, source, text) of a line of the log grammar, null if it is none.

    With `skip_eq`, lines with `=` that do not start with a quote are headers, whatever follows.
    """
    parsed = F.struct(F.regexp_extract(value, LINE, 1).alias("file"), F.regexp_extract(value, LINE, 2).alias("source"), F.regexp_extract(value, LINE, 3).alias("text"))
    is_line = value.rlike(LINE)
    if skip_eq:
        is_line = is_line & ~(value.contains("=") & ~value.startswith('"'))
    return F.when(is_line, parsed)


def quote_split(value: Column) -> Column:
    """(file, source) by splitting at quotes; null if there are fewer than three parts, no .wav comes first, or the line is a header with `=`."""
    parts = F.split(value, '"')
    file = F.trim(F.get(parts, 0))
    ok = (F.size(parts) >= 3) & file.endswith(".wav") & ~file.contains("=")
    return F.when(ok, F.struct(file.alias("file"), F.trim(F.get(parts, 1)).alias("source")))


def random_digits(value: Column) -> Column:
    """(file, number) of five-part `Random Digit` lines with a number from 10 to 100."""
    parts = F.split(value, '"')
    number = F.try_to_number(F.trim(F.get(parts, 3)), F.lit("999")).cast("int")
    ok = (F.size(parts) >= 5) & (F.get(parts, 1) == "Random Digit") & number.between(10, 100)
    return F.when(ok, F.struct(F.trim(F.get(parts, 0)).alias("file"), number.alias("number")))


def any_audio(value: Column) -> Column:
    return F.when(value.rlike(AUDIO), F.struct(F.regexp_extract(value, AUDIO, 1).alias("file"), F.regexp_extract(value, AUDIO, 3).alias("text")))


def key_value(value: Column, separator: str = " - ") -> Column:
    """(key, value) split at the first separator; null where there is none."""
    at = F.instr(value, separator)
    return F.when(at > 0, F.struct(F.trim(F.substring(value, F.lit(1), at - 1)).alias("key"), F.trim(F.substring(value, at + len(separator), F.char_length(value))).alias("value")))


def predictions(spark: SparkSession, path: str) -> DataFrame:
    """(id, label, s0, s1, score): the last three fields are split from the right, so ids may hold commas.

    A file without a header that starts with id_audio, or without both classes, is an error at once; a line of fewer
    than four fields is one when it is read. Blank lines are skipped.
    """
    head = spark.read.text(path).where("trim(value) <> ''").first()
    if head is None or not head[0].lower().startswith("id_audio"):
        raise ValueError(f"no header that starts with ID_audio: {path}")
    raw = spark.read.text(path).where("trim(value) <> '' and lower(value) not like 'id_audio%'")
    checked = F.when(F.col("value").rlike(PREDICTION), F.col("value")).otherwise(F.raise_error(F.concat(F.lit("a prediction line needs four fields: "), "value")))
    name, label, s0, s1 = (F.regexp_extract(checked, PREDICTION, k) for k in (1, 2, 3, 4))
    rows = raw.select(name.alias("id"), label.cast("int").alias("label"), s0.cast("double").alias("s0"), s1.cast("double").alias("s1")).withColumn("score", F.col("s1") - F.col("s0"))
    ones, zeros = rows.agg(F.count_if(F.col("label") == 1), F.count_if(F.col("label") == 0)).first()
    if not ones or not zeros:
        raise ValueError(f"both classes are needed: {ones} rows of label 1, {zeros} of label 0")
    return rows


def first_wins(frame: DataFrame, key: list[str], order: str) -> DataFrame:
    return frame.withColumn("__rn", F.row_number().over(Window.partitionBy(*key).orderBy(order))).where("__rn = 1").drop("__rn")


def last_wins(frame: DataFrame, key: list[str], order: str) -> DataFrame:
    return frame.withColumn("__rn", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc(order)))).where("__rn = 1").drop("__rn")


def manifest_splits(spark: SparkSession, folder: str) -> DataFrame:
    """Manifests written by `write_manifest`, split as a column."""
    return spark.read.parquet(folder)


def write_manifest(frame: DataFrame, folder: str, split: str = "split") -> None:
    """One folder for each split; an empty split of train, val, test is an error."""
    have = {r[0] for r in frame.select(split).distinct().collect()}
    if missing := {"train", "val", "test"} - have:
        raise ValueError(f"empty split: {', '.join(sorted(missing))}")
    frame.write.mode("overwrite").partitionBy(split).parquet(folder)


def disk_counts(spark: SparkSession, folder: str, pattern: str = "*.wav") -> DataFrame:
    """(folder, files, bytes) by parent folder of the files that match, without reading them."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder).select("path", "length")
    return files.groupBy(F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("folder")).agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))
