"""Byte-level text kernels in numpy: blocks of rows, words, word hashes and shingles.

Texts travel as UTF-8 bytes, so that texts with broken encodings pass through unharmed. A null text
is the empty text everywhere. Hashes have 64 bits.
"""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

U64 = np.uint64
#: Random odd base and byte values of the word hash: drawn from a fixed seed.
_RNG = np.random.default_rng(20240607)
_BASE = U64(0x9E3779B97F4A7C15)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
_SEPARATOR = b"\n"

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _class_of(*ranges: tuple[int, int]) -> np.ndarray:
    """True for the bytes outside the ranges."""
    table = np.ones(256, dtype=bool)
    for low, high in ranges:
        table[low : high + 1] = False
    return table


#: Words of running text: runs of anything but ASCII blanks.
BLANK_SPLIT = _class_of((0x20, 0x20), (0x09, 0x0D))
#: Words of letters and digits, on text whose A-Z is lowered: ASCII letters, digits and all beyond ASCII.
ALNUM = _class_of((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))


def crc_mod(column: str, m: int) -> Column:
    """crc32 of the id as text, modulo m; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % m


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that every bit depends on every bit."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def give_back() -> None:
    """Hand freed memory back to the system: workers are reused, and would else keep the largest task's footprint."""
    pa.default_memory_pool().release_unused()
    if sys.platform.startswith("linux"):
        ctypes.CDLL(None).malloc_trim(0)


def slices(batches: Iterator[pa.RecordBatch], text: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that a slice holds about `limit` bytes of text, one row at least.

    A text is never cut, so the memory of a slice follows the larger of `limit` and the longest text.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        part = (np.cumsum(sizes) - sizes) // limit
        edges = np.flatnonzero(np.diff(part)) + 1
        for a, b in zip([0, *edges], [*edges, batch.num_rows]):
            yield batch.slice(a, b - a)
    give_back()


def gathered(batches: Iterator[pa.RecordBatch], text: str, limit: int) -> Iterator[pa.Table]:
    """Tables of about `limit` bytes of text, from batches of any size; rows count for 8 bytes more than their text."""
    held, size = [], 0
    for part in slices(batches, text, limit):
        n = (pc.sum(pc.binary_length(part.column(text))).as_py() or 0) + 8 * part.num_rows
        if held and size + n > limit:
            yield pa.Table.from_batches(held)
            held, size = [], 0
        held.append(part)
        size += n
    if held:
        yield pa.Table.from_batches(held)


def sorted_distinct(values: np.ndarray) -> np.ndarray:
    """The distinct numbers in order. `np.unique` without counts goes through a hash table, which takes many times as long."""
    values = np.sort(values)
    return values[np.append(True, values[1:] != values[:-1])[: len(values)]]


def join_texts(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """One byte array with a separator after each text, and where each text starts (and the end)."""
    texts = [t or b"" for t in texts]
    data = np.frombuffer(_SEPARATOR.join(texts) + _SEPARATOR, dtype=np.uint8)
    starts = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)), out=starts[1:])
    return data, starts


class Words:
    """The words of a block of texts: byte spans, text numbers and hashes."""

    def __init__(self, texts: list[bytes | None], word_bytes: np.ndarray):
        raw, self.text_starts = join_texts(texts)
        data = _LOWER[raw]
        inside = word_bytes[data]
        flips = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        if len(inside) and inside[0]:
            flips = np.concatenate([[0], flips])
        # a separator stands at the end, and is no word byte in any class: spans close
        self.starts, self.ends = flips[0::2], flips[1::2]
        self.text = np.searchsorted(self.text_starts, self.starts, side="right") - 1
        self.n_texts = len(texts)
        self.data = data
        self.hashes = _span_hashes(data, self.starts, self.ends)
        self.counts = np.bincount(self.text, minlength=self.n_texts).astype(np.int64)
        self.bounds = np.concatenate([[0], np.cumsum(self.counts)])


_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least n of each."""
    if not _POWERS or len(_POWERS[0]) < n:
        n = max(n, 1 << 17)
        out = []
        for base in (_BASE, U64(pow(int(_BASE), -1, 1 << 64))):
            row = np.full(n, base, dtype=np.uint64)
            row[0] = 1
            out.append(np.multiply.accumulate(row))
        _POWERS[:] = out
    return _POWERS[0], _POWERS[1]


def _span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, stretch: int = 1 << 16) -> np.ndarray:
    """A hash of each byte span, the same wherever the span stands; starts are sorted."""
    out = np.zeros(len(starts), dtype=np.uint64)
    low = 0
    while low < len(starts):
        base = int(starts[low])
        high = max(low + 1, int(np.searchsorted(starts, base + stretch)))
        top = int(ends[low:high].max())
        n = top - base
        power, inverse = _powers(n + 1)
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(_BYTE[data[base:top]] * power[:n], out=sums[1:])
        a, b = starts[low:high] - base, ends[low:high] - base
        out[low:high] = mix((sums[b] - sums[a]) * inverse[a] + (b - a).astype(np.uint64))
        low = high
    return out


def shingles(words: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of `width` words, sorted and distinct by text, and their bounds by text.

    A text of fewer words, but not none, has its whole sequence as its one shingle.
    """
    h, bounds, counts = words.hashes, words.bounds, words.counts
    n = len(h)
    full = max(0, n - width + 1)
    value = np.zeros(full, dtype=np.uint64)
    for k in range(width):
        value = value * _BASE + h[k : k + full]
    value = mix(value + U64(width))
    inside = words.text[:full] == words.text[width - 1 :] if full else np.zeros(0, bool)
    text, value = words.text[:full][inside], value[inside]
    short = np.flatnonzero((counts > 0) & (counts < width))
    if len(short):
        folded = np.zeros(len(short), dtype=np.uint64)
        for k in range(width - 1):
            has = counts[short] > k
            at = np.minimum(bounds[short] + k, n - 1)
            folded = np.where(has, folded * _BASE + h[at], folded)
        folded = mix(folded + counts[short].astype(np.uint64))
        text, value = np.concatenate([text, short]), np.concatenate([value, folded])
    return sorted_sets(text, value, words.n_texts)


def sorted_sets(group: np.ndarray, value: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Values sorted and distinct within each group 0..n-1, and the groups' bounds."""
    order = np.argsort(value)
    group, value = group[order], value[order]
    order = np.argsort(group.astype(np.uint16 if n < 65536 else np.int64), kind="stable")
    group, value = group[order], value[order]
    if len(value):
        new = np.ones(len(value), dtype=bool)
        new[1:] = (value[1:] != value[:-1]) | (group[1:] != group[:-1])
        group, value = group[new], value[new]
    return value, np.searchsorted(group, np.arange(n + 1))


def expand(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[i], starts[i]+1, ... counts[i] of them, for all i, in one array."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, dtype=np.int64)
    ends = np.cumsum(counts)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - counts), counts)
