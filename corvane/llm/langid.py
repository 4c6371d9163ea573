"""Language identification by compression: a zstandard raw-content dictionary for each language.

Training takes, for each language, rows in the order of a hash of their id and text, and from each one piece of at most
`sample_bytes` bytes that starts anywhere in the text, until the dictionary is full: `dictionary_bytes` /
`sample_bytes` rows of long texts, 400 by default, and more of short ones; repeated rows teach once. A text is cut into pieces
of `piece_bytes`, all of it; each piece, in lower case, is compressed with each dictionary, and the language with the
smallest total wins. Where the runner-up is closer than `margin`, relative to the size without a
dictionary, the prediction stands as the best guess but is marked `rejected`.

Only the dictionaries are broadcast: languages times `dictionary_bytes`, together at most `total_bytes`. With
more languages than fit, each dictionary is smaller; no language is left out.

Defined cases: null texts and texts without a letter are `und` with score 0; ties go to the language that
sorts first; without training rows every text is `und`.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .columns import given_back, set_aside

UNDETERMINED = "und"
LEVEL = 3


def train(documents: DataFrame, *, doc_id: str, text: str, lang: str, sample_bytes: int = 250, dictionary_bytes: int = 100_000, total_bytes: int = 50_000_000) -> dict[str, bytes]:
    """A dictionary for each language value; rows with null language or text teach nothing."""
    lowered = F.lower(F.col(f"`{text}`")).cast("binary")
    length = F.least(F.octet_length(lowered), F.lit(sample_bytes))
    labelled = documents.select(*dict.fromkeys([doc_id, text, lang])).where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    sizes = labelled.groupBy(F.col(lang).alias("__lang")).agg(F.count("*").alias("n"), F.avg(length).alias("mean"))
    sizes = [(r["__lang"], r["n"], r["mean"]) for r in sizes.collect()]
    if not sizes:
        return {}
    held = max(1, min(dictionary_bytes, total_bytes // len(sizes)))
    # a quarter more rows than fill a dictionary on average, since the draw is not exact
    shares = [(x, min(1.0, (1.25 * held / max(1.0, mean + 1) + 20) / n)) for x, n, mean in sizes]
    share = documents.sparkSession.createDataFrame(shares, T.StructType([T.StructField("__lang", documents.schema[lang].dataType), T.StructField("__share", T.DoubleType())]))
    draw = lambda seed: F.pmod(F.xxhash64(F.lit(seed), F.col(doc_id), F.col(text)), F.lit(1 << 40)) / (1 << 40)
    picked = labelled.join(F.broadcast(share), F.col(lang) == F.col("__lang")).where(draw(6) < F.col("__share"))
    start = F.floor(draw(7) * (F.octet_length(lowered) - length + 1)).cast("int") + 1
    rows = picked.select(F.col(lang), draw(6), F.substring(lowered, start, F.lit(sample_bytes))).distinct().collect()
    pieces: dict[str, bytes] = {}
    for language, _, piece in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        filled = pieces.get(language)
        if filled is None or len(filled) < held:
            pieces[language] = bytes(piece)[:held] if filled is None else (filled + b"\n" + bytes(piece))[:held]
    return pieces


class CompressionClassifier:
    """Sizes of a text under each language's dictionary."""

    def __init__(self, dictionaries: dict[str, bytes], piece_bytes: int = 4096):
        self.languages = sorted(dictionaries)
        self.piece_bytes = piece_bytes
        self.packers = []
        for language in self.languages:
            content = zstandard.ZstdCompressionDict(dictionaries[language], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            content.precompute_compress(level=LEVEL)
            self.packers.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=content, write_content_size=False, write_checksum=False))
        self.plain = zstandard.ZstdCompressor(level=LEVEL, write_content_size=False, write_checksum=False)

    def sizes(self, text: bytes) -> tuple[list[int], int]:
        pieces = [text[k : k + self.piece_bytes] for k in range(0, len(text), self.piece_bytes)]
        return [sum(len(p.compress(x)) for x in pieces) for p in self.packers], sum(len(self.plain.compress(x)) for x in pieces)

    def judge(self, text: bytes) -> tuple[str, float, float]:
        """(language, score, margin): score is the share of the best saving among the two best languages."""
        sizes, plain = self.sizes(text)
        order = sorted(range(len(sizes)), key=lambda k: (sizes[k], self.languages[k]))
        best = order[0]
        second = sizes[order[1]] if len(order) > 1 else plain
        saved, rival = max(0, plain - sizes[best]), max(0, plain - second)
        score = saved / (saved + rival) if saved + rival else 0.5
        return self.languages[best], score, (second - sizes[best]) / max(1, plain)


def predict(documents: DataFrame, dictionaries: dict[str, bytes], *, text: str = "text", margin: float = 0.01) -> DataFrame:
    """The documents' columns but the text, with `lang_pred`, `score` (0 to 1), `margin` and `rejected`; such columns, in any case of
    letters, are replaced."""
    added = T.StructType.fromDDL("lang_pred string, score double, margin double, rejected boolean")
    documents, renamed = set_aside(documents, "__text", "__letter")
    text = renamed.get(text, text)
    fields = [f for f in documents.schema.fields if f.name.lower() not in {*added.names, text.lower()}]
    shared = documents.sparkSession.sparkContext.broadcast(dictionaries)
    has_letter = F.coalesce(F.col(f"`{text}`").rlike(r"\p{L}"), F.lit(False))
    frame = documents.select(*[F.col(f"`{f.name}`") for f in fields], F.lower(F.col(f"`{text}`")).cast("binary").alias("__text"), has_letter.alias("__letter"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = CompressionClassifier(shared.value)
        for batch in batches:
            out = []
            for raw, letter in zip(batch.column("__text"), batch.column("__letter").to_pylist()):
                language, score, apart = model.judge(raw.as_py()) if letter and model.languages else (UNDETERMINED, 0.0, 0.0)
                out.append((language, score, apart, apart < margin))
            columns = {f.name: batch.column(f.name) for f in fields}
            kinds = (pa.string(), pa.float64(), pa.float64(), pa.bool_())
            yield pa.RecordBatch.from_pydict(columns | {n: pa.array(c, k) for n, c, k in zip(added.names, zip(*out) if out else [[]] * 4, kinds)})

    return given_back(frame.mapInArrow(run, T.StructType(fields + added.fields)), renamed)


def identify(documents: DataFrame, learn: Column, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Train on the rows where `learn` holds and predict all rows from their text."""
    dictionaries = train(documents.where(learn), doc_id=doc_id, text=text, lang=lang)
    return predict(documents.drop(lang), dictionaries, text=text)
