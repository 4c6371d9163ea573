"""Packing documents into sequences of bounded tokens, documents and attention cost, by vector best fit.

A document's ids are those of its text and an end id. Longer ones than a sequence holds are cut into pieces of its
length. A piece is a vector of its tokens, 1 for itself, and its cost of attention, the square of its tokens; a sequence
has a capacity of each. Pieces go by falling size into the sequence that fits best under every constraint: by
default where the weighted norm of what would be left is least, or where the weighted dot product of the piece and what is left is
largest; a new sequence is opened only where no open one has room in every dimension.

Tokenizing: a text's words between ASCII blanks have the same ids wherever they stand, since the tokenizer drops white space and
joins nothing across it. So each distinct word of a slice of texts is tokenized once, with a bounded memory of
earlier slices' words, and texts are put together from word ids in arrays. Texts are read once; one narrow row for each piece is stored.

Packing: stored pieces are dealt evenly, by a hash of their place, into blocks of about `block_pieces`, and a task packs a
block, so its memory is bounded and no key is hot. Each block leaves its last sequences partly empty; these are opened
and their pieces packed anew, together, in fewer blocks, until one block holds them or most of them would be opened again. The number
of rounds grows with the log of the pieces.

Defined cases: a null or empty text is its end id alone; a null id and repeated ids are documents like others; an empty table packs to nothing;
broken UTF-8 is read with replacement characters; strings of special tokens in a text are ordinary text. Other columns play no part,
but those in `keep` come back in the struct `row`, whatever their names.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stored import Scratch
from .textblocks import BLANK_SPLIT, expand, give_back, join_texts, slices


class WordIds:
    """Ids of words by a tokenizer that treats words between blanks apart; the words of the last slices are kept."""

    def __init__(self, path: str, most_words: int = 400_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.most = most_words
        self.words, self.bounds, self.ids = pa.array([], pa.binary()), np.zeros(1, np.int64), np.zeros(0, np.uint32)

    def _encode(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each word has, and all ids in order."""
        counts, ids = [np.zeros(0, np.int64)], [np.zeros(0, np.uint32)]
        for at in range(0, len(words), 20_000):
            texts = [w.decode("utf-8", "replace") for w in words.slice(at, 20_000).to_pylist()]
            found = self.tokenizer.encode(texts, is_pretokenized=True, add_special_tokens=False)
            ids.append(np.array(found.ids, dtype=np.uint32))
            counts.append(np.bincount(np.array(found.word_ids, dtype=np.int64), minlength=len(texts)))
        return np.concatenate(counts), np.concatenate(ids)

    def of(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For distinct words: where each one's ids start, how many they are, and the ids."""
        known = pc.index_in(words, value_set=self.words) if len(self.words) else pa.nulls(len(words), pa.int32())
        fresh = pc.is_null(known).to_numpy(zero_copy_only=False)
        new = words.filter(pa.array(fresh))
        counts, ids = self._encode(new)
        if len(self.words) + len(new) > self.most:
            # the memory starts anew from this slice's words
            old = pc.fill_null(known, 0).to_numpy(zero_copy_only=False)[~fresh]
            n_old = np.diff(self.bounds)[old]
            kept = self.ids[expand(self.bounds[:-1][old], n_old)]
            self.words = words.filter(pa.array(~fresh))
            self.bounds, self.ids = np.concatenate([[0], np.cumsum(n_old)]), kept
            known = pc.index_in(words, value_set=self.words)
        base = len(self.words)
        self.words = pa.concat_arrays([self.words, new])
        self.bounds = np.concatenate([self.bounds, self.bounds[-1] + np.cumsum(counts)])
        self.ids = np.concatenate([self.ids, ids])
        place = pc.fill_null(known, 0).to_numpy(zero_copy_only=False).astype(np.int64)
        place[fresh] = base + np.arange(len(new))
        return self.bounds[place], np.diff(self.bounds)[place], self.ids


def token_ids(texts: list[bytes | None], words: WordIds, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts, each with the end id, in one array, and the texts' bounds in it."""
    data, text_starts = join_texts(texts)
    inside = BLANK_SPLIT[data]
    flips = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if len(inside) and inside[0]:
        flips = np.concatenate([[0], flips])
    starts, ends = flips[0::2], flips[1::2]
    offsets = np.concatenate([[0], np.cumsum(ends - starts)])
    raw = pa.py_buffer(data[inside].tobytes())
    spans = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets.astype(np.int64)), raw])
    coded = spans.dictionary_encode()
    at, n, ids = words.of(coded.dictionary.cast(pa.binary()))
    index = coded.indices.to_numpy(zero_copy_only=False)
    text = np.searchsorted(text_starts, starts, side="right") - 1
    lengths = np.bincount(text, weights=n[index], minlength=len(texts)).astype(np.int64) + 1
    bounds = np.concatenate([[0], np.cumsum(lengths)])
    out = np.full(int(bounds[-1]), end, dtype=np.uint32)
    filled = np.ones(len(out), dtype=bool)
    filled[bounds[1:] - 1] = False
    out[filled] = ids[expand(at[index], n[index])]
    return out, bounds


def pieces(documents: DataFrame, tokenizer: str, *, capacity: int = 4096, end: int = 1, doc_id: str = "doc_id", text: str = "text", with_ids: bool = False, keep: list[str] | None = None, slice_bytes: int = 4 << 20) -> DataFrame:
    """(id, piece, start, length, ids_crc32) of each document's pieces; `ids` if asked for, and `row` where `keep` names columns."""
    kept = [F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row")] if keep else []
    read = documents.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").cast("binary").alias("text"), *kept)
    ddl = f"id {read.schema['id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long"
    ddl += (", ids array<int>" if with_ids else "") + (f", row {read.schema['row'].dataType.simpleString()}" if keep else "")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordIds(tokenizer)
        for batch in slices(batches, "text", slice_bytes):
            ids, bounds = token_ids(batch.column("text").to_pylist(), words, end)
            n = -(-np.diff(bounds) // capacity)
            doc = np.repeat(np.arange(len(n)), n)
            piece = expand(np.zeros(len(n), np.int64), n)
            low = bounds[doc] + piece * capacity
            high = np.minimum(low + capacity, bounds[doc + 1])
            raw = ids.astype("<u4", copy=False)
            crc = [zlib.crc32(raw[a:b]) for a, b in zip(low, high)]
            out = {"id": batch.column("id").take(pa.array(doc)), "piece": pa.array(piece, pa.int32()), "start": pa.array(piece * capacity), "length": pa.array(high - low), "ids_crc32": pa.array(crc, pa.int64())}
            if with_ids:
                out["ids"] = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], high - bounds[0]]), pa.int32()), pa.array(ids.astype(np.int32)))
            if keep:
                out["row"] = batch.column("row").take(pa.array(doc))
            yield pa.RecordBatch.from_pydict(out)

    return read.mapInArrow(cut, ddl)


def best_fit(length: np.ndarray, capacities: np.ndarray, weights: np.ndarray, rule: str = "norm") -> tuple[np.ndarray, np.ndarray]:
    """The bin and the place in it of each piece. A piece that exceeds a capacity by itself gets a bin of its own.

    Vectors are measured in shares of the capacities. Bins that have no room left for the smallest piece are put aside.
    """
    if rule not in ("norm", "dot"):
        raise ValueError("the rule is norm or dot")
    n = len(length)
    size = np.stack([length, np.ones(n, dtype=np.int64), length * length], axis=1)
    share = size / capacities
    order = np.argsort(-(share @ weights), kind="stable")
    # what the smallest piece of those to come takes
    least = size[order][::-1]
    least = np.minimum.accumulate(least, axis=0)[::-1]
    bins, place = np.empty(n, dtype=np.int64), np.empty(n, dtype=np.int64)
    room = np.empty((max(n, 1), 3), dtype=np.int64)
    number, used = np.empty(max(n, 1), dtype=np.int64), np.empty(max(n, 1), dtype=np.int64)
    n_open = n_bins = 0
    for step, i in enumerate(order):
        if step % 256 == 0:
            alive = np.flatnonzero((room[:n_open] >= least[step]).all(axis=1))
            for held in (room, number, used):
                held[: len(alive)] = held[alive]
            n_open = len(alive)
        fits = np.flatnonzero((room[:n_open, 0] >= size[i, 0]) & (room[:n_open, 1] >= 1) & (room[:n_open, 2] >= size[i, 2]))
        if len(fits):
            left = room[fits] / capacities
            if rule == "norm":
                at = fits[np.argmin(((left - share[i]) ** 2) @ weights)]
            else:
                at = fits[np.argmax((left * share[i]) @ weights)]
        else:
            at = n_open
            room[at], number[at], used[at] = capacities, n_bins, 0
            n_open, n_bins = n_open + 1, n_bins + 1
        bins[i], place[i] = number[at], used[at]
        used[at] += length[i]
        room[at] -= size[i]
    return bins, place


def pack(rows: DataFrame, scratch: Scratch, *, capacity: int = 4096, most_documents: int | None = None, most_cost: int | None = None, weights: tuple[float, float, float] = (1.0, 0.05, 0.2), rule: str = "norm", block_pieces: int = 8192) -> DataFrame:
    """Rows of `pieces` with `sequence_id` and `offset`; without further limits than tokens, those of documents and cost never bind."""
    capacities = np.array([capacity, most_documents or capacity, most_cost or capacity * capacity], dtype=np.int64)
    w = np.array(weights, dtype=float)
    names = [f.name for f in rows.schema]
    body = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)

    def one(table: pa.Table) -> pa.Table:
        """Pieces of a block with their sequence, the place there, and whether the sequence is full enough."""
        table = table.sort_by([("length", "descending"), ("ids_crc32", "ascending"), ("id", "ascending"), ("piece", "ascending")])
        length = table.column("length").to_numpy()
        bins, place = best_fit(length, capacities, w, rule)
        n = int(bins.max()) + 1
        used = np.stack([np.bincount(bins, minlength=n), *(np.bincount(bins, weights=x, minlength=n) for x in (length, length * length))], axis=1)
        full = (used[:, [1, 0, 2]] >= capacities - capacities // 128).any(axis=1)
        base = table.column("base")[0].as_py()
        out = {n: table.column(n) for n in names}
        out |= {"sequence_id": pa.array(base + bins), "offset": pa.array(place), "closed": pa.array(full[bins])}
        give_back()
        return pa.table(out)

    left, done, base = scratch.put(rows), [], 0
    n = left.count()
    while n:
        blocks = -(-n // block_pieces)
        # dealt evenly by the place in the stored table; a block opens at most as many sequences as it has pieces
        number = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(blocks)).alias("block")
        dealt = left.select(*names, number).withColumn("base", F.lit(base) + F.col("block") * F.lit(1 << 32))
        packed = scratch.put(dealt.groupBy("block").applyInArrow(one, f"{body}, sequence_id long, offset long, closed boolean"))
        base += blocks << 32
        reopened = packed.where("not closed").select(*names)
        n_left = reopened.count() if blocks > 1 else 0
        # where other limits leave most sequences open, packing again would not close them
        if 2 * n_left > n:
            n_left = 0
        done.append(packed.where("closed") if n_left else packed)
        left, n = reopened, n_left
    out = done[0] if done else left.select("*", F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    for more in done[1:]:
        out = out.union(more)
    return out.select(*names, "sequence_id", "offset")


def pack_documents(documents: DataFrame, tokenizer: str, *, capacity: int = 4096, end: int = 1, doc_id: str = "doc_id", text: str = "text", with_ids: bool = False, keep: list[str] | None = None, **limits) -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset) of all pieces of all documents."""
    cut = pieces(documents, tokenizer, capacity=capacity, end=end, doc_id=doc_id, text=text, with_ids=with_ids, keep=keep)
    return pack(cut, Scratch(documents.sparkSession, "packing"), capacity=capacity, **limits)
