"""Toxicity by non-negative positive-unlabelled learning.

Positives are texts confirmed as toxic; the unlabelled set is drawn from all training text, toxic or not.
The class prior is the share of toxic rows among the labelled training rows. A linear model over hashed
words is trained in numpy on the risk  prior * R+(positives) + max(0, R-(unlabelled) -
prior * R-(positives)): where the second part falls below zero, the step goes against it.

A text's features are the words present, each once, so that one telling word in a very long text keeps
its weight. Training reads at most about `positive_rows` and `unlabelled_rows` rows, picked by a hash of their
id and text, and repeated rows once; executors turn their texts into bucket numbers, and the driver sees only those of buckets that get a weight.
Scoring reads every text whole.

Defined cases: a null or empty text has no features and gets the model's base score; repeated rows get
equal scores; labels with a null id or value teach nothing; without positives every score is the prior.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .columns import given_back, set_aside
from .stored import Scratch
from .textblocks import ALNUM, U64, Words, _span_hashes, expand, give_back, mix, slices, sorted_distinct

BUCKETS = 1 << 20
SLICE = 1 << 20
#: Besides each word, its first bytes count as features, so that inflected forms share what they begin with.
STEMS = (4, 5, 6, 7, 8)


def features(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of the words of each text and of the words' beginnings, and the texts' bounds."""
    words = Words(texts, ALNUM)

    def keys(hashes: np.ndarray, text: np.ndarray) -> np.ndarray:
        return text.astype(np.uint64) * U64(BUCKETS) + (mix(hashes) & U64(BUCKETS - 1))

    found = [keys(words.hashes, words.text)]
    for n in STEMS:
        longer = np.flatnonzero(words.ends - words.starts > n)
        starts = words.starts[longer]
        found.append(keys(_span_hashes(words.data, starts, starts + n) + U64(n), words.text[longer]))
    distinct = sorted_distinct(np.concatenate(found))
    return (distinct & U64(BUCKETS - 1)).astype(np.uint32), np.searchsorted(distinct, np.arange(words.n_texts + 1, dtype=np.uint64) * U64(BUCKETS))


@dataclass
class Model:
    """Weights by bucket, with a bias."""

    weights: np.ndarray
    bias: float

    def score(self, values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0.0], np.cumsum(self.weights[values.astype(np.int64)], dtype=np.float64)])
        raw = sums[bounds[1:]] - sums[bounds[:-1]] + self.bias
        return 1 / (1 + np.exp(-np.clip(raw, -30, 30)))


def fit(positive: list[np.ndarray], unlabelled: list[np.ndarray], active: np.ndarray, in_p: np.ndarray, in_u: np.ndarray, prior: float, *, epochs: int = 20, rate: float = 0.05, batch: int = 1024, decay: float = 1e-5, seed: int = 8) -> Model:
    """Minibatch Adam on the non-negative risk with the sigmoid loss, which is bounded: a logistic loss lets
    well-fitted positives drive the estimate of the negative part below zero and stops learning.

    Rows are arrays of places in `active`, the buckets that are learned; `in_p` and `in_u` say in how many rows each is.
    """
    prior = min(max(prior, 1e-4), 0.9)
    base = float(np.log(prior / (1 - prior)))
    if not positive:
        return Model(np.zeros(BUCKETS, dtype=np.float32), base)
    rng = np.random.default_rng(seed)
    unlabelled = unlabelled or [np.zeros(0, np.int32)]
    packed = lambda rows: (np.concatenate(rows).astype(np.int64), np.cumsum([0, *map(len, rows)]))
    (pv, pb), (uv, ub) = packed(positive), packed(unlabelled)
    # a start from single buckets: prior * rate among positives / rate among all is the chance of being toxic
    chance = np.clip(prior * (in_p / len(positive)) / ((in_u + 1) / len(unlabelled)), prior, 0.95)
    w, bias = np.log(chance / (1 - chance)) - base, base
    m, v = np.zeros(len(active) + 1), np.zeros(len(active) + 1)
    step = 0

    def rows(values: np.ndarray, bounds: np.ndarray, pick: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = bounds[pick + 1] - bounds[pick]
        return values[expand(bounds[pick], size)], np.repeat(np.arange(len(pick)), size)

    for _ in range(epochs):
        order = rng.permutation(len(ub) - 1)
        for low in range(0, len(order), batch):
            pick_u = order[low : low + batch]
            pick_p = rng.choice(len(pb) - 1, min(len(pb) - 1, batch), replace=False)
            (fu, ru), (fp, rp) = rows(uv, ub, pick_u), rows(pv, pb, pick_p)
            zu = np.bincount(ru, w[fu], len(pick_u)) + bias
            zp = np.bincount(rp, w[fp], len(pick_p)) + bias
            su, sp = 1 / (1 + np.exp(-np.clip(zu, -30, 30))), 1 / (1 + np.exp(-np.clip(zp, -30, 30)))
            negative = su.mean() - prior * sp.mean()
            slope_u, slope_p = su * (1 - su) / len(pick_u), prior * sp * (1 - sp) / len(pick_p)
            # the positive part pulls positives up once, the negative part once more; below zero it is undone
            gu, gp = (slope_u, -2 * slope_p) if negative >= 0 else (-slope_u, slope_p)
            grad = np.bincount(fu, gu[ru], len(active)) + np.bincount(fp, gp[rp], len(active)) + decay * w
            grad = np.append(grad, gu.sum() + gp.sum())
            step += 1
            m = 0.9 * m + 0.1 * grad
            v = 0.999 * v + 0.001 * grad * grad
            move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
            w -= move[:-1]
            bias -= move[-1]
    weights = np.zeros(BUCKETS, dtype=np.float32)
    weights[active] = w
    return Model(weights, bias)


def _featurised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct buckets of each sampled text, as bytes."""
    for batch in slices(batches, "__text", SLICE):
        values, bounds = features(batch.column("__text").to_pylist())
        packed = [values[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:])]
        yield pa.RecordBatch.from_pydict({"positive": batch.column("positive"), "draw": batch.column("draw"), "buckets": pa.array(packed, pa.binary())})


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many positive and unlabelled rows of a task each bucket is."""
    held = np.zeros((2, BUCKETS), dtype=np.int32)
    for batch in batches:
        for positive, raw in zip(batch.column("positive").to_pylist(), batch.column("buckets")):
            held[1 - positive, np.frombuffer(raw.as_buffer(), np.uint32)] += 1
    found = np.flatnonzero(held.any(0))
    yield pa.RecordBatch.from_pydict({"bucket": pa.array(found, pa.int64()), "in_p": pa.array(held[0, found], pa.int64()), "in_u": pa.array(held[1, found], pa.int64())})
    give_back()


def train(documents: DataFrame, labels: DataFrame, learn: Column, *, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", positive_rows: int = 2500, unlabelled_rows: int = 6000, z: float = 5.0) -> Model:
    """Learn from the rows of both tables where `learn`, an expression over the id, holds.

    Executors cut the sampled texts into features and count them. The driver gets the buckets that are clearly more
    frequent among the positives (`z` deviations), which alone get a weight, and which of them each sampled row holds.
    """
    known = labels.where(learn & F.col(doc_id).isNotNull() & F.col(label).isNotNull()).groupBy(doc_id).agg(F.max(label).alias("__toxic"))
    n, n_toxic = known.agg(F.count("*"), F.sum((F.col("__toxic") == 1).cast("long"))).first()
    if not n_toxic:
        return Model(np.zeros(BUCKETS, dtype=np.float32), float(np.log(1e-4)))
    rows = documents.where(learn).select(F.col(doc_id), F.col(text).cast("binary").alias("__text"))

    def picked(frame: DataFrame, positive: int, wanted: int, salt: int) -> DataFrame:
        share = min(1.0, wanted / max(1, frame.count()))
        here = F.pmod(F.xxhash64(F.lit(salt), F.col(doc_id), "__text"), F.lit(1 << 20)) < int((1 << 20) * share)
        return frame.where(here).select(F.lit(positive).alias("positive"), F.xxhash64(F.col(doc_id), "__text").alias("draw"), "__text")

    toxic = rows.join(known.where("__toxic = 1").select(doc_id), doc_id)
    picks = picked(toxic, 1, positive_rows, 81).union(picked(rows, 0, unlabelled_rows, 82))
    scratch = Scratch(documents.sparkSession, "toxicity")
    # rows that repeat an id and a text share a draw: however many there are, the sample holds one
    sample = scratch.put(picks.mapInArrow(_featurised, "positive int, draw long, buckets binary").dropDuplicates(["positive", "draw"]))
    n_p, n_u = (x or 0 for x in sample.agg(F.sum("positive"), F.sum(1 - F.col("positive"))).first())
    counts = sample.mapInArrow(_counted, "bucket long, in_p long, in_u long").groupBy("bucket").agg(F.sum("in_p").alias("in_p"), F.sum("in_u").alias("in_u"))
    expected = F.lit(float(n_p)) * (F.col("in_u") + 1) / F.lit(float(max(1, n_u)))
    telling = (F.col("in_p") >= 3) & (F.col("in_p") - expected > z * F.sqrt(expected)) & (F.col("in_p") > 2 * expected)
    found = sorted(tuple(r) for r in counts.where(telling).collect())
    active, in_p, in_u = np.array(found, dtype=np.int64).reshape(-1, 3).T

    def narrowed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [np.flatnonzero(np.isin(active, np.frombuffer(raw.as_buffer(), np.uint32))).astype(np.int32).tobytes() for raw in batch.column("buckets")]
            yield pa.RecordBatch.from_pydict({"positive": batch.column("positive"), "draw": batch.column("draw"), "places": pa.array(held, pa.binary())})

    held = sorted((r[0], r[1], bytes(r[2])) for r in sample.mapInArrow(narrowed, "positive int, draw long, places binary").collect())
    scratch.drop(sample)
    of = lambda kind: [np.frombuffer(places, np.int32) for positive, _, places in held if positive == kind]
    return fit(of(1), of(0), active, in_p, in_u, n_toxic / n)


def score(documents: DataFrame, model: Model, *, text: str = "text", threshold: float = 0.3, slice_bytes: int = SLICE) -> DataFrame:
    """Add `score` (0 to 1) and `predicted` (1 from the threshold on) to the documents; such columns, in any case of letters, are replaced."""
    added = T.StructType.fromDDL("score double, predicted int")
    documents, renamed = set_aside(documents, "__text")
    text = renamed.get(text, text)
    fields = [f for f in documents.schema.fields if f.name.lower() not in added.names]
    shared = documents.sparkSession.sparkContext.broadcast(model)
    frame = documents.select(*[F.col(f"`{f.name}`") for f in fields], F.col(f"`{text}`").cast("binary").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "__text", slice_bytes):
            scores = shared.value.score(*features(batch.column("__text").to_pylist()))
            columns = {f.name: batch.column(f.name) for f in fields}
            yield pa.RecordBatch.from_pydict(columns | {"score": pa.array(scores), "predicted": pa.array((scores >= threshold).astype(np.int32))})

    return given_back(frame.mapInArrow(run, T.StructType(fields + added.fields)), renamed)
