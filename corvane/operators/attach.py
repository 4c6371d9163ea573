"""Joins that attach what is known elsewhere to clips, and the plans that follow from what is found."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .stored import stored

NO_SOURCE = "<no source in log>"


def one_of_each(frame: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """A row for each key, that of the smallest values."""
    return frame.groupBy(key).agg(F.min(F.struct(*columns)).alias("__one")).select(key, *[F.col(f"__one.{c}").alias(c) for c in columns])


def attach_system(predictions: DataFrame, manifest: DataFrame, system: str = "method") -> DataFrame:
    """Predictions with their clip's system; null, and `matched` false, where the manifest lacks the id."""
    known = one_of_each(manifest, "id", [system]).withColumn("matched", F.lit(True))
    return predictions.join(known, "id", "left").withColumn("matched", F.coalesce("matched", F.lit(False)))


def path_stem(column: Column) -> Column:
    """A path's last part without its last suffix."""
    return F.regexp_replace(F.regexp_replace(column, r"^.*/", ""), r"(.)\.[^.]*$", "$1")


def attach_speaker(predictions: DataFrame, manifest: DataFrame, speaker: str = "speaker", fatal: bool = True) -> DataFrame:
    """Predictions with their speaker, by id, else by the id's stem. A prediction without one is an error when it is read, unless `fatal` is False."""
    known = one_of_each(manifest, "id", [speaker])
    out = predictions.join(known, "id", "left").withColumn("__stem", path_stem(F.col("id")))
    out = out.join(known.select(F.col("id").alias("__stem"), F.col(speaker).alias("__by_stem")), "__stem", "left")
    found = F.coalesce(speaker, "__by_stem")
    if fatal:
        found = F.coalesce(found, F.raise_error(F.concat(F.lit("no speaker for "), F.col("id"))).cast(manifest.schema[speaker].dataType))
    return out.withColumn(speaker, found).drop("__stem", "__by_stem")


def attach_features(manifest: DataFrame, features: DataFrame, path: str = "path") -> DataFrame:
    """Manifest rows with their features, null where there are none."""
    return manifest.join(features.dropDuplicates([path]), path, "left")


def attach_gender(clips: DataFrame, speakers: DataFrame, speaker: str = "speaker", gender: str = "gender") -> tuple[DataFrame, DataFrame]:
    """(clips with their speaker's gender, speakers with clips but without one and how many clips go with them).

    Of several genders of a speaker the smallest that is not empty counts, lowered.
    """
    known = speakers.select(speaker, F.lower(F.trim(gender)).alias(gender)).where(F.col(gender) != "").groupBy(speaker).agg(F.min(gender).alias(gender))
    lost = clips.join(known, speaker, "left_anti").groupBy(speaker).agg(F.count("*").alias("clips"))
    return clips.join(known, speaker), lost


def attach_source(files: DataFrame, sources: DataFrame, keys: list[str]) -> DataFrame:
    """Files with the `source` that a log names for them, or a marker that none does."""
    return files.join(one_of_each(sources.withColumn("__key", F.struct(*keys)), "__key", ["source"]).select("__key.*", "source"), keys, "left").withColumn("source", F.coalesce("source", F.lit(NO_SOURCE)))


def attach_transcript(samples: DataFrame, lines: DataFrame, speaker: str = "speaker", block_names: int = 20_000, chunk_lines: int = 50_000) -> DataFrame:
    """Samples with the `text` of their genuine file: the first line of their speaker's transcript that contains its name, blanks around it cut; empty where there is none.

    `samples` has the speaker and a `file`, `lines` the speaker, a number `line` and the whole line as `value`. Names meet lines by substring, at any place: an automaton of a block of a
    speaker's names reads a chunk of the speaker's lines once, so neither a speaker of very many names nor one of very many lines
    fills a task, and what leaves a task is one line at most for each name. A task reads its speakers one after the other from one
    sorted stream, so that very many small speakers cost it their rows and no more.
    """
    samples = stored(samples, "transcripts")
    wanted = samples.select(F.col(speaker).alias("of"), original_file(F.col("file")).alias("name")).where("of is not null and name is not null").distinct()
    given = lines.select(F.col(speaker).alias("of"), "line", "value").where("of is not null and value is not null")
    pieces = lambda rows, n, to: rows.groupBy("of").agg(F.ceil(F.count("*") / n).cast("long").alias(to)).where(F.col(to) > 1)
    # only speakers of more than one block or chunk: a row for block_names names or chunk_lines lines at most
    sizes = F.broadcast(pieces(wanted, block_names, "blocks").join(pieces(given, chunk_lines, "chunks"), "of", "full"))
    blocks, chunks = (F.coalesce(n, F.lit(1).cast("long")) for n in ("blocks", "chunks"))
    deal = lambda by, n: F.pmod(F.xxhash64(by), n)
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    names = wanted.join(sizes, "of", "left").select("of", deal("name", blocks).alias("block"), each(chunks).alias("chunk"), "name", F.lit(None).cast(lines.schema["line"].dataType).alias("line"), F.lit(None).cast("string").alias("value"))
    read = given.join(sizes, "of", "left").select("of", each(blocks).alias("block"), deal("line", chunks).alias("chunk"), F.lit(None).cast("string").alias("name"), "line", "value")
    key = ["of", "block", "chunk"]
    stream = names.union(read).repartition(*key).sortWithinPartitions(*key, F.col("name").isNull(), F.col("line").asc_nulls_last(), "value")
    kinds = {"of": lines.schema[speaker].dataType.simpleString(), "line": lines.schema["line"].dataType.simpleString()}
    found = stream.mapInArrow(first_lines, f"of {kinds['of']}, name string, line {kinds['line']}, value string")
    best = found.groupBy("of", "name").agg(F.min_by("value", "line").alias("value"))
    best = best.select(F.col("of").alias("__of"), F.col("name").alias("__name"), F.regexp_replace("value", r"^\s+|\s+$", "").alias("text"))
    out = samples.join(best, (F.col(speaker) == F.col("__of")) & (original_file(F.col("file")) == F.col("__name")), "left").drop("__of", "__name")
    return out.withColumn("text", F.coalesce("text", F.lit("")))


def first_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(of, name, line, value): the first line that contains each name. Rows come by (of, block, chunk), of each first the names and then the lines in order."""
    import ahocorasick

    # the group that the stream is in, its names until its first line, then the automaton and the names not met yet
    key, names, automaton, left = None, [], None, set()
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        keys = [rows.column(c).combine_chunks() for c in ("of", "block", "chunk")]
        name, value = (rows.column(c).to_numpy().tolist() for c in ("name", "value"))
        is_name = rows.column("name").is_valid().to_numpy()
        turn = np.zeros(batch.num_rows, bool)
        for column in keys:
            turn[1:] |= pc.not_equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False)
        starts = [0, *np.flatnonzero(turn).tolist(), batch.num_rows]
        at, hits = [], []
        for lo, hi in zip(starts, starts[1:]):
            if lo == hi:
                continue
            if lo or [column[0] for column in keys] != key:
                names, automaton = [], None
            middle = lo + int(is_name[lo:hi].sum())
            names += name[lo:middle]
            if middle == hi:
                continue
            if automaton is None:
                automaton, left = ahocorasick.Automaton(), set(names)
                for known in left - {""}:
                    automaton.add_word(known, known)
                automaton.make_automaton()
            for i in range(middle, hi):
                if not left:
                    break
                met = {known for _, known in automaton.iter(value[i])} if len(automaton) else set()
                # an empty name is in every line
                met = (met | {""}) & left
                left -= met
                at += [i] * len(met)
                hits += met
        if batch.num_rows:
            key = [column[-1] for column in keys]
        if at:
            first = rows.take(pa.array(at, pa.int64())).combine_chunks()
            yield from pa.table([first.column("of"), pa.array(hits, pa.string()), first.column("line"), first.column("value")], names=["of", "name", "line", "value"]).to_batches()


def original_file(file: Column) -> Column:
    """A generated file's genuine name: .1.wav and .2.wav become .wav."""
    return F.regexp_replace(file, r"\.[12]\.wav$", ".wav")


def spoof_variants(stem: Column) -> Column:
    """The file names that generators give a stem."""
    return F.array(F.concat(stem, F.lit(".1.wav")), F.concat(stem, F.lit(".2.wav")))


def without_excluded(files: DataFrame, sources: DataFrame, excluded: Column, keys: list[str]) -> DataFrame:
    """Files that no log line of an excluded source names."""
    return files.join(sources.where(excluded).select(*keys).distinct(), keys, "left_anti")


def quarantine_plan(targets: DataFrame, existing: DataFrame, roots: list[str], to: str) -> DataFrame:
    """(src, dst, action): of every target (speaker, stem) its genuine file and variants under each root, where (root, speaker, file) exists.

    Nothing is moved; the plan says what would be.
    """
    files = targets.select("speaker", F.explode(F.concat(F.array(F.concat("stem", F.lit(".wav"))), spoof_variants(F.col("stem")))).alias("file")).distinct()
    wanted = files.select(F.explode(F.array(*[F.lit(r) for r in roots])).alias("root"), "speaker", "file")
    there = wanted.join(existing.select("root", "speaker", "file").distinct(), ["root", "speaker", "file"], "left_semi")
    return there.select(F.concat_ws("/", "root", "speaker", "file").alias("src"), F.concat_ws("/", F.lit(to), "root", "speaker", "file").alias("dst"), F.lit("move").alias("action"))


def _bucket(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.col(key)), F.lit(buckets)).cast("int")


def _digests(key: str, of: Column | None = None, name: str = "") -> list[Column]:
    """Count and two sums of hashes of the keys: alike for equal multisets in any order, and for others with a chance of some 2**-100."""
    kept = lambda x: x if of is None else F.when(of, x)
    sums = [F.coalesce(F.sum(kept(h.cast("decimal(20,0)"))), F.lit(0)).alias(f"__s{i}{name}") for i, h in enumerate((F.xxhash64(F.lit("first"), F.col(key)), F.xxhash64(F.lit("second"), F.col(key))))]
    return [F.count(kept(F.lit(1))).alias(f"__n{name}"), *sums]


def _both(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.select(key, F.lit(True).alias("__left")).union(b.select(key, F.lit(False)))


def _differing(a: DataFrame, b: DataFrame, key: str, buckets: int) -> DataFrame:
    """The buckets in which the frames' keys are not equal as multisets. What is shuffled are counts and sums, not keys."""
    return _odd(_both(a, b, key), key, buckets)


def _odd(both: DataFrame, key: str, buckets: int) -> DataFrame:
    left = F.col("__left")
    found = both.groupBy(_bucket(key, buckets).alias("__bucket")).agg(*_digests(key, left, "_a"), *_digests(key, ~left, "_b"))
    return found.where(F.struct("__n_a", "__s0_a", "__s1_a") != F.struct("__n_b", "__s0_b", "__s1_b")).select("__bucket")


def model_alignment(scores: DataFrame, model: str = "model", key: str = "id", unique: bool = False, buckets: int = 4096) -> DataFrame:
    """(id, models, missing): ids that not every model scores exactly once; none if the models can be compared.

    With `unique`, no model has an id twice. Then models are compared by digests of buckets of ids first, and only ids of buckets where they
    differ are grouped; where all agree no id is shuffled.
    """
    if unique:
        # as many rows as there are buckets and models
        by = scores.groupBy(_bucket(key, buckets).alias("__bucket"), F.col(model).alias("__m")).agg(*_digests(key))
        names = F.broadcast(scores.agg(F.count_distinct(model).alias("__all")))
        agreed = by.groupBy("__bucket").agg(F.count("*").alias("__have"), F.count_distinct(F.struct("__n", "__s0", "__s1")).alias("__kinds")).crossJoin(names)
        odd = F.broadcast(agreed.where("__have <> __all or __kinds > 1").select("__bucket"))
        held = scores.withColumn("__bucket", _bucket(key, buckets)).join(odd, "__bucket", "left_semi").drop("__bucket")
    else:
        held = scores
    models = scores.agg(F.sort_array(F.collect_set(model)).alias("__every"))
    by_id = held.groupBy(key).agg(F.sort_array(F.collect_list(model)).alias("models")).crossJoin(F.broadcast(models))
    return by_id.where(F.col("models") != F.col("__every")).select(key, F.array_join("models", ",").alias("models"), F.array_join(F.array_except("__every", "models"), ",").alias("missing"))


def symmetric_difference(a: DataFrame, b: DataFrame, key: str, buckets: int = 4096) -> DataFrame:
    """(key, side) of keys in one frame only; none if the two sets are equal. Null keys count as one key.

    Buckets of keys whose digests agree are left out before anything is grouped. Keys are written, so that neither frame is made twice.
    """
    return _one_sided(stored(_both(a, b, key), "sides"), key, buckets)


def _one_sided(both: DataFrame, key: str, buckets: int) -> DataFrame:
    odd = F.broadcast(_odd(both, key, buckets))
    held = both.withColumn("__bucket", _bucket(key, buckets)).join(odd, "__bucket", "left_semi")
    sides = held.groupBy(key).agg(F.max("__left").alias("__a"), F.max(~F.col("__left")).alias("__b"))
    return sides.where("not (__a and __b)").select(key, F.when(F.col("__a"), "left").otherwise("right").alias("side"))


def same_set(a: DataFrame, b: DataFrame, key: str, buckets: int = 4096) -> bool:
    """Whether both frames have the same keys, however often."""
    both = stored(_both(a, b, key), "sides")
    return _odd(both, key, buckets).isEmpty() or _one_sided(both, key, buckets).isEmpty()


def set_differences(rows: DataFrame, system: str, key: str) -> DataFrame:
    """(one, other, differing, same) of every two systems: how many keys only one of them has. Null keys count as one key.

    Rows are read once and keys are grouped once, whatever the number of systems; what follows has a row for each combination of
    systems that have a key in common.
    """
    held = stored(rows.where(F.col(system).isNotNull()).select(system, key), "systems")
    # a flag for each system, which are few
    names = sorted(r[0] for r in held.select(system).distinct().collect())
    flags = held.groupBy(key).agg(*[F.max(F.col(system) == name).alias(f"__{k}") for k, name in enumerate(names)])
    pairs = [(i, j) for i in range(len(names)) for j in range(i + 1, len(names))]
    wide = flags.agg(F.count("*").alias("__keys"), *[F.count_if(F.col(f"__{i}") != F.col(f"__{j}")).alias(f"__{i}_{j}") for i, j in pairs])
    kind, found = rows.schema[system].dataType, [F.col(f"__{i}_{j}") for i, j in pairs]
    out = [F.struct(F.lit(names[i]).cast(kind).alias("one"), F.lit(names[j]).cast(kind).alias("other"), n.alias("differing"), (n == 0).alias("same")) for (i, j), n in zip(pairs, found)]
    # fewer than two systems have no pair
    none = F.expr(f"cast(array() as array<struct<one: {kind.simpleString()}, other: {kind.simpleString()}, differing: bigint, same: boolean>>)")
    return wide.select(F.inline(F.array(*out) if out else none))


def systems(rows: DataFrame, method: str = "method") -> DataFrame:
    """The distinct systems among the spoofs."""
    return rows.where(F.col(method).isNotNull() & (F.col(method) != "none")).select(method).distinct()
