"""Benchmark decontamination by an FM-index per shard of training text.

Each task cuts its documents into shards, writes a shard's words as integers, sorts the suffixes, keeps
the last column (Burrows-Wheeler) in a wavelet matrix and searches all benchmark phrases backwards at
once. Occurrences are located by walking back to a sampled suffix position; their word spans are merged.

Before indexing, words that no phrase holds fold into one break, and runs between breaks that are
shorter than the shortest phrase go: no occurrence can touch them. Breaks sort by position, and the
word after a break always has its suffix position sampled, so a walk never crosses one.

Only the phrases travel to the workers, as arrays, in blocks of about `block_bytes` of item text and some 25 times
that in arrays, one narrow pass for each block; documents are never shuffled.

Defined cases: a null or empty text has no words; null item texts or ids are no items; repeated rows
are judged one by one; equal item ids count once; an empty benchmark hits nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .columns import given_back, set_aside
from .textblocks import ALNUM, Words, expand, slices

SAMPLE = 16


class WaveletMatrix:
    """Rank of any symbol in any prefix of an integer sequence, one bit of the symbol at a time."""

    def __init__(self, symbols: np.ndarray, n_symbols: int):
        self.bits = max(1, int(n_symbols - 1).bit_length())
        self.ones, self.zeros = [], []
        row = symbols
        for b in range(self.bits - 1, -1, -1):
            bit = (row >> b) & 1
            ones = np.zeros(len(row) + 1, dtype=np.int32)
            np.cumsum(bit, out=ones[1:])
            self.ones.append(ones)
            self.zeros.append(len(row) - int(ones[-1]))
            row = np.concatenate([row[bit == 0], row[bit == 1]])

    def rank(self, symbol: np.ndarray, end: np.ndarray) -> np.ndarray:
        low, high = np.zeros_like(end), end
        for level in range(self.bits):
            ones, zeros = self.ones[level], self.zeros[level]
            up = (symbol >> (self.bits - 1 - level)) & 1
            low = np.where(up, zeros + ones[low], low - ones[low])
            high = np.where(up, zeros + ones[high], high - ones[high])
        return high - low


def sort_suffixes(symbols: np.ndarray) -> np.ndarray:
    """Suffix order of positive integers with breaks (0), which sort first and by their position.

    Prefix doubling: a suffix is settled once a break falls in what was compared. The sequence ends
    with a break.
    """
    n = len(symbols)
    is_break = symbols == 0
    n_break = int(is_break.sum())
    rank = np.where(is_break, np.cumsum(is_break) - 1, symbols.astype(np.int64) + n_break)
    order = np.argsort(rank, kind="stable")
    span = 1
    while True:
        sorted_rank = rank[order]
        new = np.ones(n, dtype=bool)
        new[1:] = sorted_rank[1:] != sorted_rank[:-1]
        group = np.cumsum(new) - 1
        head = np.flatnonzero(new)
        rank = np.empty(n, dtype=np.int64)
        rank[order] = head[group]
        size = np.diff(np.append(head, n))
        open_ = np.flatnonzero(size[group] > 1)
        if not len(open_):
            return order
        at = order[open_]
        # `at + span` exists: a suffix whose compared part holds the last break is alone
        second = rank[np.minimum(at + span, n - 1)]
        inner = np.lexsort((second, group[open_]))
        order[open_] = at[inner]
        key = rank[order[open_]] * np.int64(n + 1) + second[inner]
        fresh = np.ones(len(open_), dtype=bool)
        fresh[1:] = key[1:] != key[:-1]
        at = order[open_]
        rank[at] = open_[np.flatnonzero(fresh)[np.cumsum(fresh) - 1]]
        span *= 2


class FMIndex:
    """Counts and positions of phrases in a sequence of positive integers with breaks (0)."""

    def __init__(self, symbols: np.ndarray, n_symbols: int):
        suffix = sort_suffixes(symbols)
        self.n = len(symbols)
        self.last = symbols[suffix - 1]
        self.less = np.zeros(n_symbols + 1, dtype=np.int64)
        np.cumsum(np.bincount(symbols, minlength=n_symbols), out=self.less[1:])
        self.tree = WaveletMatrix(self.last, n_symbols)
        sampled = (suffix % SAMPLE == 0) | (self.last == 0)
        self.sampled = sampled
        self.sample_rank = np.cumsum(sampled) - 1
        self.samples = suffix[sampled]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last row of each phrase (rows of a matrix), searched from its last symbol."""
        low = np.zeros(len(phrases), dtype=np.int64)
        high = np.full(len(phrases), self.n, dtype=np.int64)
        alive = np.arange(len(phrases))
        for k in range(phrases.shape[1] - 1, -1, -1):
            c = phrases[alive, k]
            low[alive] = self.less[c] + self.tree.rank(c, low[alive])
            high[alive] = self.less[c] + self.tree.rank(c, high[alive])
            alive = alive[high[alive] > low[alive]]
        high[high < low] = low[high < low]
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        rows, steps = rows.copy(), np.zeros(len(rows), dtype=np.int64)
        walking = np.flatnonzero(~self.sampled[rows])
        while len(walking):
            at = rows[walking]
            c = self.last[at]
            rows[walking] = self.less[c] + self.tree.rank(c, at)
            steps[walking] += 1
            walking = walking[~self.sampled[rows[walking]]]
        return self.samples[self.sample_rank[rows]] + steps


class Phrases:
    """The windows of a block of benchmark items as sorted arrays, with the items that hold each.

    Made once, on the driver, and sent to the workers: 4 bytes for each word of a window, 8 for its first holder and 4 for
    each holder, so some 50 bytes for a word of item text.
    """

    def __init__(self, items: list[tuple[str, bytes]], width: int):
        words = Words([text for _, text in items], ALNUM)
        self.vocabulary, inverse = np.unique(words.hashes, return_inverse=True)
        symbol = inverse.astype(np.int32) + 1
        self.names, item_of = np.unique(np.array([item for item, _ in items], dtype=object), return_inverse=True)
        length = np.minimum(words.counts, width)
        self.tables = []
        for n in np.unique(length[length > 0]).tolist():
            rows = np.flatnonzero(length == n)
            count = words.counts[rows] - n + 1
            starts = expand(words.bounds[rows], count)
            windows = np.lib.stride_tricks.sliding_window_view(symbol, n)[starts]
            order = np.lexsort((np.repeat(item_of[rows], count), *windows.T[::-1]))
            windows, holder = windows[order], np.repeat(item_of[rows], count)[order].astype(np.int32)
            new = np.append(True, (windows[1:] != windows[:-1]).any(1))
            kept = np.append(True, new[1:] | (holder[1:] != holder[:-1]))
            self.tables.append((n, windows[new], np.append(np.flatnonzero(new[kept]), kept.sum()), holder[kept]))
        self.shortest = self.tables[0][0] if self.tables else 0


def _occurrences(words: Words, phrases: Phrases) -> tuple[np.ndarray, list[set[str]]]:
    """Which words of a shard lie in an occurrence, and the items found in each text."""
    hit = np.zeros(len(words.hashes) + 1, dtype=np.int64)
    items: list[set[str]] = [set() for _ in range(words.n_texts)]
    known = phrases.vocabulary
    if not phrases.shortest or not len(words.hashes):
        return hit[:-1] > 0, items
    at = np.searchsorted(known, words.hashes)
    at[at == len(known)] = 0
    in_vocabulary = known[at] == words.hashes
    starts_run = in_vocabulary.copy()
    starts_run[1:] &= ~in_vocabulary[:-1] | (words.text[1:] != words.text[:-1])
    run = np.cumsum(starts_run) - 1
    place = np.flatnonzero(in_vocabulary)
    length = np.bincount(run[place]) if len(place) else np.zeros(0, dtype=np.int64)
    place = place[length[run[place]] >= phrases.shortest]
    if not len(place):
        return hit[:-1] > 0, items
    # a break after each run that stays; `source` leads from the sequence back to the word
    runs = run[place]
    closes = np.append(runs[1:] != runs[:-1], True)
    slot = np.arange(len(place)) + np.cumsum(closes) - closes
    symbols = np.zeros(len(place) + int(closes.sum()), dtype=np.int64)
    symbols[slot] = at[place] + 1
    source = np.zeros(len(symbols), dtype=np.int64)
    source[slot] = place
    index = FMIndex(symbols, len(known) + 1)
    for width, table, bounds, holders in phrases.tables:
        low, high = index.search(table)
        found = np.flatnonzero(high > low)
        if not len(found):
            continue
        count = (high - low)[found]
        first = source[index.locate(expand(low[found], count))]
        np.add.at(hit, first, 1)
        np.add.at(hit, first + width, -1)
        text, phrase = np.unique(np.stack([words.text[first], np.repeat(found, count)]), axis=1)
        each = bounds[phrase + 1] - bounds[phrase]
        pairs = np.unique(np.stack([np.repeat(text, each), holders[expand(bounds[phrase], each)]]), axis=1)
        for text, item in pairs.T.tolist():
            items[text].add(phrases.names[item])
    return np.cumsum(hit)[:-1] > 0, items


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, block_bytes: int) -> Iterator[list[tuple[str, bytes]]]:
    rows = benchmark.select(F.col(id_col).cast("string"), F.col(text_col).cast("binary")).where(f"`{id_col}` is not null and `{text_col}` is not null")
    block, size = [], 0
    for item, text in rows.toLocalIterator():
        block.append((item, bytes(text)))
        size += len(text)
        if size >= block_bytes:
            yield block
            block, size = [], 0
    if block:
        yield block


def find_phrases(
    documents: DataFrame,
    benchmark: DataFrame,
    *,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    width: int = 10,
    block_bytes: int = 2 << 20,
    shard_bytes: int = 4 << 20,
) -> DataFrame:
    """Add to each document: `n_words` long, `hit_spans` array of (start, end) byte spans of hit words,
    merged where words adjoin, `n_hit` long, `hit_items` sorted array of item ids as text.

    Columns of those names in `documents`, in any case of letters, are replaced; all others come back unchanged, whatever
    their names, the text among them.
    """
    added = T.StructType.fromDDL("n_words long, n_hit long, hit_spans array<struct<start:long,end:long>>, hit_items array<string>, _hit_words binary")
    documents, renamed = set_aside(documents, "__text", "_hit_words")
    text = renamed.get(text, text)
    kept = [f for f in documents.schema.fields if f.name.lower() not in added.names]
    frame = documents.select(*[F.col(f"`{f.name}`") for f in kept])
    schema = T.StructType(kept + added.fields)

    def pass_over(frame: DataFrame, items: list[tuple[str, bytes]], first: bool) -> DataFrame:
        shared = frame.sparkSession.sparkContext.broadcast(Phrases(items, width))

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            phrases = shared.value
            for batch in slices(batches, "__text", shard_bytes):
                words = Words(batch.column("__text").to_pylist(), ALNUM)
                hit, found = _occurrences(words, phrases)
                if not first:
                    earlier = batch.column("_hit_words").to_pylist()
                    hit |= np.frombuffer(b"".join(earlier), dtype=bool)
                    for mine, more in zip(found, batch.column("hit_items").to_pylist()):
                        mine.update(more)
                spans = _spans(words, hit)
                columns = {f.name: batch.column(f.name) for f in kept}
                columns |= {
                    "n_words": pa.array(words.counts, pa.int64()),
                    "n_hit": pa.array(np.bincount(words.text[hit], minlength=words.n_texts), pa.int64()),
                    "hit_spans": spans,
                    "hit_items": pa.array([sorted(x) for x in found], pa.list_(pa.string())),
                    "_hit_words": pa.array([hit[a:b].tobytes() for a, b in zip(words.bounds[:-1], words.bounds[1:])], pa.binary()),
                }
                yield pa.RecordBatch.from_pydict(columns)

        return frame.withColumn("__text", F.col(f"`{text}`").cast("binary")).mapInArrow(scan, schema)

    first = True
    for items in _blocks(benchmark, item_id, item_text, block_bytes):
        frame, first = pass_over(frame, items, first), False
    if first:
        frame = pass_over(frame, [], True)
    return given_back(frame.drop("_hit_words"), renamed)


def _spans(words: Words, hit: np.ndarray) -> pa.Array:
    """Merged byte spans of hit words by text, relative to the text."""
    place = np.flatnonzero(hit)
    opens = np.ones(len(place), dtype=bool)
    opens[1:] = (place[1:] != place[:-1] + 1) | (words.text[place[1:]] != words.text[place[:-1]])
    closes = np.append(opens[1:], True) if len(place) else opens
    text = words.text[place[opens]]
    shift = words.text_starts[text]
    values = pa.StructArray.from_arrays(
        [pa.array(words.starts[place[opens]] - shift, pa.int64()), pa.array(words.ends[place[closes]] - shift, pa.int64())],
        names=["start", "end"],
    )
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(text, np.arange(words.n_texts + 1)), pa.int32()), values)


def cut_spans(documents: DataFrame, *, text: str = "text", spans: str = "hit_spans", glue: str = " ") -> DataFrame:
    """Replace each span of a text by `glue`; texts without spans stay as they are. JVM only.

    Spans lie on character borders, since words do.
    """
    raw = F.col(f"`{text}`").cast("binary")
    starts = F.concat(F.array(F.lit(0).cast("long")), F.transform(F.col(spans), lambda s: s["end"]))
    ends = F.concat(F.transform(F.col(spans), lambda s: s["start"]), F.array(F.octet_length(raw).cast("long")))
    pieces = F.transform(F.arrays_zip(starts.alias("a"), ends.alias("b")), lambda p: F.substring(raw, p["a"].cast("int") + 1, (p["b"] - p["a"]).cast("int")).cast("string"))
    return documents.withColumn(text, F.when(F.size(F.col(spans)) > 0, F.array_join(pieces, glue)).otherwise(F.col(f"`{text}`")))


def report(found: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """The digest of one scan: counts, and the hash of the items found."""
    return found.select(
        doc_id, "n_words", "n_hit", F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hit_items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def digest_of(items: list[str]) -> str:
    """The hash that `report` gives for a list of items."""
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
