"""Removal of repeated 50-byte strings with suffix arrays made by induced sorting.

A byte goes if a 50-byte string that covers it also starts in a document of smaller id. The work is cut so
that no task holds more than a block of documents or a shard of candidate strings:

1. Documents are dealt into blocks. In every 50-byte window the 8-byte string of smallest hash, the first of equal ones, has 21 bytes
   before it in the window, or 21 behind it: with these it is the window's anchor. Windows that are equal have equal anchors, and
   29 bytes agree by chance far more seldom than the 8. A block sends its distinct anchors, some seven for a hundred bytes, to parts
   by ranges of their hashes, in steps, and learns which occur in two documents, a bit for each.
2. Runs of windows with one repeated anchor are segments. Each block sends its distinct segments, with the
   smallest id that holds each, to shards by anchor. An anchor in more than `HOT` documents is dealt finer,
   one window for a segment and by the window's own hash, so that no anchor fills a shard. Shards are dealt
   to parts, one for each shuffle partition of the session or more; a block sends a part one row.
3. A part takes its shards one after the other. A shard concatenates its distinct segments that share an anchor with others, sorts all suffixes by induced sorting (suffix types, sorted
   leftmost-S substrings, then two inducing passes), computes permuted common prefixes with the preceding
   window, and so finds for each distinct window the smallest id. It answers each block in runs, by the segments' numbers.
4. Each block merges the answers into removal spans and cuts its texts.

Answers go by place, not by key. So a block's texts are taken in the order of id and text wherever it is read, and what it sends is
the same each time.

Induced sorting works on runs of one symbol, so that a long run costs no more than a short one, and takes at once
all buckets up to the next one that they induce into, in numpy. The string of substring names is sorted by the same
routine, whatever the size of its alphabet. Windows are compared byte by byte in step 3; 64-bit hashes only
route strings and fold equal ones.

Defined cases: a null or empty text is empty bytes and keeps nothing; shorter texts than 50 bytes stay; a
null id counts as larger than any other; rows of one id never remove from each other; an empty table gives
an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .columns import given_back, set_aside
from .routing import ROUTED_DDL, block_number, blocks_of, by_part, by_range, from_planes, from_steps, pack, parts_for, planes, routed, steps, tidy, unpack
from .textblocks import U64, _span_hashes, expand, join_texts, mix, sorted_distinct

WIDTH = 50
GRAM = 8
#: An anchor is a gram with so many bytes before or behind it: a window that has fewer before it has as many behind it.
REACH = (WIDTH - GRAM) // 2
#: Bytes of an anchor's hash. Anchors that meet by chance cost work, and change nothing.
KEY = 5
HOT = 1000
#: Places that are hashed at a time: their arrays stay in a core's cache.
CHUNK = 1 << 17
#: The low bits of a gram's hash that give way to its place in a chunk.
PLACE = U64((1 << 22) - 1)
NO_ID = np.iinfo(np.int64).max


# ---------------------------------------------------------------- suffix arrays by induced sorting


def _stable_slots(target: np.ndarray, pointer: np.ndarray, step: int) -> np.ndarray:
    """Where each item of `target` (bucket numbers, in order) goes; moves the buckets' pointers."""
    narrow = target.astype(np.uint16) if len(pointer) <= 65536 else target
    order = np.argsort(narrow, kind="stable")
    ordered = target[order]
    opens = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
    count = np.diff(np.append(opens, len(ordered)))
    slots = np.empty(len(target), dtype=np.int64)
    slots[order] = pointer[ordered] + step * (np.arange(len(ordered)) - np.repeat(opens, count))
    pointer[ordered[opens]] += step * count
    return slots


class _Runs:
    """A string as runs of one symbol. A run is of type S if the symbol after it is larger, else of type L.

    Suffixes that start inside a run follow from the run's own place: those of one symbol and type are ordered by how
    much of the run is left, then by the place of what comes after the run. So only starts of runs are induced.
    """

    def __init__(self, t: np.ndarray, n_symbols: int):
        self.start = np.flatnonzero(np.append(True, t[1:] != t[:-1])).astype(np.int32)
        self.length = np.diff(np.append(self.start, len(t))).astype(np.int32)
        self.symbol = t[self.start].astype(np.int32)
        self.n_symbols = n_symbols
        self.is_s = np.append(self.symbol[:-1] < self.symbol[1:], False)
        self.lms = np.flatnonzero(self.is_s[1:] & ~self.is_s[:-1]) + 1
        self.longest = int(self.length.max())
        count = lambda runs: np.bincount(self.symbol[runs], minlength=n_symbols).astype(np.int64)
        self.n_l, self.n_s, self.n_lms = count(~self.is_s), count(self.is_s), count(self.lms)
        self.down, self.up = self._batches(False), self._batches(True)
        self.longer_before = np.append(0, np.cumsum(np.bincount(self.symbol[self.length > 1], minlength=n_symbols)))

    def _batches(self, up: bool) -> list[tuple[int, int]]:
        """(first, last) symbols of stretches that can be handled at once: no run of a stretch induces into it."""
        runs = np.flatnonzero(self.is_s[:-1] if up else ~self.is_s[:-1])
        source, target = self.symbol[runs + 1], self.symbol[runs]
        if up:  # mirrored, so that both passes go upwards
            source, target = self.n_symbols - 1 - source, self.n_symbols - 1 - target
        nearest = np.full(self.n_symbols, self.n_symbols, dtype=np.int64)
        order = np.argsort(source.astype(np.uint16) if self.n_symbols <= 65536 else source, kind="stable")
        opens = np.flatnonzero(np.append(True, source[order[1:]] != source[order[:-1]])) if len(order) else order
        if len(order):
            nearest[source[order[opens]]] = np.minimum.reduceat(target[order], opens)
        live = (self.n_l + self.n_s if up else self.n_l + self.n_lms) > 0
        live = np.flatnonzero(live[::-1] if up else live)
        # a stretch ends before the first symbol that one of it induces into: the least of those from its start on
        ends = np.minimum.accumulate(np.searchsorted(live, nearest[live])[::-1])[::-1].tolist()
        out, at = [], 0
        while at < len(live):
            out.append((int(live[at]), int(live[ends[at] - 1])))
            at = ends[at]
        return [(self.n_symbols - 1 - b, self.n_symbols - 1 - a) for a, b in out] if up else out

    def _by_length(self, runs: np.ndarray, first: int, final: int, n: int, up: bool) -> np.ndarray:
        """Runs of the symbols `first` to `final`, symbol by symbol with `n` runs of one type before the others: those n by length."""
        if self.longer_before[final + 1] == self.longer_before[first]:
            return runs
        length = self.length[runs]
        if first == final:  # all but few runs have length 1
            longer = np.flatnonzero(length[:n] > 1)
            if not len(longer):
                return runs
            by_length = longer[np.argsort(length[longer], kind="stable")]
            return np.concatenate([runs[:n][length[:n] == 1], runs[by_length], runs[n:]])
        symbols = self.symbol[runs].astype(np.int64)
        key = (self.n_symbols - symbols if up else symbols) * np.int64(self.longest + 2) + np.where(self.is_s[runs] == up, length, self.longest + 1)
        return runs[np.argsort(key, kind="stable")]

    def induce(self, lms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """From leftmost-S runs in the given order: all runs by symbol, L before S, in order of their starts; and as they were entered."""
        size = self.n_l + self.n_lms
        head = np.cumsum(size) - size
        down, entered_l = np.empty(int(size.sum()), dtype=np.int32), np.empty(int(size.sum()), dtype=np.int32)
        if len(lms):
            down[_stable_slots(self.symbol[lms], head + self.n_l, 1)] = lms
        pointer = head.copy()
        last = len(self.symbol) - 1
        down[pointer[self.symbol[last]]] = last
        pointer[self.symbol[last]] += 1
        for first, final in self.down:
            a, b = head[first], head[final] + size[final]
            runs = down[a:b]
            entered_l[a:b] = runs
            runs = self._by_length(runs, first, final, self.n_l[first], False)
            down[a:b] = runs
            before = runs[runs > 0] - 1
            before = before[~self.is_s[before]]
            if len(before):
                down[_stable_slots(self.symbol[before], pointer, 1)] = before
        size = self.n_l + self.n_s
        head = np.cumsum(size) - size
        out, entered = np.empty(len(self.symbol), dtype=np.int32), np.empty(len(self.symbol), dtype=np.int32)
        places = expand(head, self.n_l)
        of_l = ~self.is_s[down]
        out[places], entered[places] = down[of_l], entered_l[~self.is_s[entered_l]]
        pointer = head + size - 1
        for first, final in self.up:
            a, b = head[first], head[final] + size[final]
            runs = out[a:b]
            if first == final:
                entered[a + self.n_l[first] : b] = runs[self.n_l[first] :]
            else:
                s_part = self.is_s[runs]
                entered[a:b][s_part] = runs[s_part]
            runs = self._by_length(runs[::-1], first, final, self.n_s[first], True)
            out[a:b] = runs[::-1]
            before = runs[runs > 0] - 1
            before = before[self.is_s[before]]
            if len(before):
                out[_stable_slots(self.symbol[before], pointer, -1)] = before
        return out, entered

    def expanded(self, entered: np.ndarray) -> np.ndarray:
        """The order of all suffixes, from the order in which runs were entered."""
        if self.longest == 1:
            return self.start[entered]
        length = self.length[entered]
        left = expand(np.ones(len(entered), dtype=np.int64), length)
        runs = np.repeat(entered, length)
        s = self.is_s[runs]
        key = (2 * self.symbol[runs].astype(np.int64) + s) * (self.longest + 1) + np.where(s, self.longest - left, left)
        order = np.argsort(key, kind="stable")
        return (self.start[runs] + self.length[runs] - left.astype(np.int32))[order]


def _sorted_substrings(t: np.ndarray, n_symbols: int, lms: np.ndarray, most_rounds: int = 256) -> tuple[np.ndarray, np.ndarray] | None:
    """Order of the leftmost-S substrings, and their names in that order; None where one is too long for this.

    As many symbols as fit are packed into a number, and ties sorted by the next ones. Of two substrings of which one
    begins with the other, the longer is smaller, so what lies behind an end counts as larger than any symbol.
    """
    length = np.append(np.diff(lms) + 1, len(t) + 1 - lms[-1])  # the last holds the end, as no other does
    bits = int(n_symbols + 1).bit_length()
    each = 63 // bits
    if length.max() > most_rounds * each:
        return None
    padded = np.concatenate([t.astype(np.int64) + 1, np.zeros(each * (int(length.max()) // each + 2), dtype=np.int64)])
    behind = (1 << bits) - 1

    def keys(of: np.ndarray, start: int) -> np.ndarray:
        out = np.zeros(len(of), dtype=np.int64)
        at, left = lms[of] + start, length[of] - start
        for k in range(each):
            out = (out << bits) | np.where(left > k, padded[at + k], behind)
        return out

    key = keys(np.arange(len(lms)), 0)
    order = np.argsort(key)
    key = key[order]
    new = np.append(True, key[1:] != key[:-1])
    open_, done = np.arange(len(order)), 0
    while True:
        # groups of several of which one goes on
        done += each
        opens = np.flatnonzero(new[open_])
        size = np.diff(np.append(opens, len(open_)))
        goes_on = np.maximum.reduceat(length[order[open_]], opens) > done
        keep = np.repeat((size > 1) & goes_on, size)
        group, open_ = np.repeat(np.arange(len(opens)), size)[keep], open_[keep]
        if not len(open_):
            return order, np.cumsum(new) - 1
        own = order[open_]
        key = keys(own, done)
        inner = np.lexsort((key, group))
        order[open_], key = own[inner], key[inner]
        new[open_[1:]] |= (key[1:] != key[:-1]) & (group[1:] == group[:-1])


def _names(t: np.ndarray, lms: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Names of the leftmost-S substrings in their order: equal ones, up to and with the next such place, share a name."""
    length = np.append(np.diff(lms) + 1, len(t) + 1 - lms[-1])
    place = lms[ordered]
    same = (length[ordered[1:]] == length[ordered[:-1]]) & (ordered[1:] != len(lms) - 1) & (ordered[:-1] != len(lms) - 1)
    for k in np.flatnonzero(same).tolist():
        a, b, n = place[k], place[k + 1], length[ordered[k]]
        same[k] = np.array_equal(t[a : a + n], t[b : b + n])
    return np.cumsum(np.append(False, ~same))


def suffix_array(t: np.ndarray, n_symbols: int) -> np.ndarray:
    """Order of all suffixes of t (symbols 0..n_symbols-1); the end sorts before any symbol.

    Leftmost-S substrings are sorted, named, and the string of their names is sorted by this same routine, whatever the
    size of its alphabet; all other suffixes are induced.
    """
    n = len(t)
    if n < 2:
        return np.zeros(n, dtype=np.int32)
    runs = _Runs(t, n_symbols)
    lms = runs.lms
    if len(lms) > 1:
        places = runs.start[lms].astype(np.int64)
        found = _sorted_substrings(t, n_symbols, places)
        if found is None:  # long ones are sorted by a first induction
            number = np.full(len(runs.start), -1, dtype=np.int32)
            number[lms] = np.arange(len(lms))
            rough = number[runs.induce(lms)[0]]
            found = (ordered := rough[rough >= 0]), _names(t, places, ordered)
        ordered, names = found
        if names[-1] + 1 == len(lms):
            lms = lms[ordered]
        else:
            reduced = np.empty(len(lms), dtype=np.int32)
            reduced[ordered] = names
            lms = lms[suffix_array(reduced, int(names[-1]) + 1)]
    return runs.expanded(runs.induce(lms)[1])


def common_prefixes(data: np.ndarray, order: np.ndarray, width: int) -> np.ndarray:
    """For each place of `order`, the common prefix with the place before it, at most `width`.

    Permuted: worked out in text order, eight bytes at a time, then put back into suffix order.
    """
    padded = np.concatenate([data, np.zeros(width + 8, dtype=np.uint8)])
    words = np.ndarray((len(padded) - 7,), dtype="<u8", buffer=padded, strides=(1,))
    rank = np.argsort(order[1:], kind="stable")
    place, before = order[1:][rank], order[:-1][rank]
    common = np.zeros(len(place), dtype=np.int64)
    going = np.arange(len(place))
    for k in range(0, width, 8):
        x = words[place[going] + k] ^ words[before[going] + k]
        differs = x != 0
        low = x[differs] & (~x[differs] + U64(1))
        common[going[differs]] = k + (np.log2(low.astype(np.float64)).astype(np.int64) >> 3)
        going = going[~differs]
    common[going] = width
    out = np.zeros(len(order), dtype=np.int64)
    out[1:][rank] = np.minimum(common, width)
    return out


# ---------------------------------------------------------------- anchors and segments of a block


def _as_words(data: np.ndarray) -> np.ndarray:
    """The 8-byte string at each place, as a number."""
    padded = np.concatenate([data, np.zeros(8, dtype=np.uint8)])
    return np.ndarray((len(padded) - 7,), dtype="<u8", buffer=padded, strides=(1,))


def _gram_order(words: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Numbers by whose order the grams of a window compete; the low bits are the place."""
    return mix(words * U64(0x9E3779B97F4A7C15)) & ~PLACE | place.astype(np.uint64)


def _begin(window: np.ndarray, gram: np.ndarray) -> np.ndarray:
    """Where the anchors of windows begin, from where the windows and their grams do."""
    return np.where(gram - window >= REACH, gram - REACH, gram)


def _anchor_hashes(words: np.ndarray, begins: np.ndarray) -> np.ndarray:
    h = np.zeros(len(begins), dtype=np.uint64)
    for k in [*range(0, GRAM + REACH - 7, 8), GRAM + REACH - 8]:
        h = mix(h * U64(0x9E3779B97F4A7C15) + words[begins + k])
    return h >> U64(64 - 8 * KEY)


def _with_others(strings: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Which of the distinct segments that begin there share their anchor with another one; the rest hold no window of another."""
    words, least = _as_words(strings), None
    for k in range(WIDTH - GRAM + 1):
        h = _gram_order(words[begins + k], np.full(len(begins), k))
        least = h if least is None else np.minimum(least, h)
    anchor = _anchor_hashes(words, begins + _begin(np.zeros(len(begins), dtype=np.int64), (least & PLACE).astype(np.int64)))
    _, of, count = np.unique(anchor, return_inverse=True, return_counts=True)
    return count[of] > 1


def _anchors(data: np.ndarray, starts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(text, first window, number of windows, anchor) of the runs of windows with one anchor, chunk by chunk."""
    grams = WIDTH - GRAM + 1
    for low in range(0, len(data), CHUNK):
        part = data[low : low + CHUNK + WIDTH - 1]
        n = len(part) - WIDTH + 1
        if n <= 0:
            break
        words = _as_words(part)
        h = _gram_order(words[: n + grams - 1], np.arange(n + grams - 1))
        span = 1
        while span * 2 <= grams:
            h = np.minimum(h[:-span], h[span:])
            span *= 2
        rest = grams - span
        h = (np.minimum(h[:-rest], h[rest:]) if rest else h)[:n]
        begins = _begin(np.arange(n), (h & PLACE).astype(np.int64))
        first = np.searchsorted(starts, low, side="right") - 1
        ends = starts[first + 1 :] - 1
        upto = np.searchsorted(starts, low + n - 1, side="right") - first
        inside = np.ones(n, dtype=bool)
        for end in ends[:upto]:
            inside[max(0, end - WIDTH + 1 - low) : end + 1 - low] = False
        opens = inside.copy()
        opens[1:] &= ~inside[:-1] | (begins[1:] != begins[:-1])
        opened = np.flatnonzero(opens)
        if not len(opened):
            continue
        closed = np.flatnonzero(inside & np.append(opens[1:] | ~inside[1:], True))
        anchor = _anchor_hashes(words, begins[opened])
        new = np.append(True, (anchor[1:] != anchor[:-1]) | (opened[1:] != closed[:-1] + 1))  # equal anchors at neighbouring places are one run
        opened, closed, anchor = opened[new], closed[np.append(new[1:], True)], anchor[new]
        yield np.searchsorted(starts, opened + low, side="right") - 1, opened + low, closed - opened + 1, anchor


def _in_order(table: pa.Table) -> pa.Table:
    """A block's rows by id and text: the same however they arrived, so that what is asked by place is answered by place."""
    return table.take(pc.sort_indices(table.select(["__id", "__text"]), sort_keys=[("__id", "ascending"), ("__text", "ascending")]))


class Block:
    """The texts of a block, in order, as one byte array, with every segment."""

    def __init__(self, table: pa.Table):
        self.ids = np.array([NO_ID if x is None else x for x in table.column("__id").to_pylist()], dtype=np.int64)
        self.texts = [x or b"" for x in table.column("__text").to_pylist()]
        self.data, self.starts = join_texts(self.texts)
        runs = list(_anchors(self.data, self.starts))
        self.text, self.first, self.count, self.anchor = (np.concatenate([r[k] for r in runs]) if runs else np.zeros(0, np.uint64 if k == 3 else np.int64) for k in range(4))
        self.distinct = sorted_distinct(self.anchor)

    def segments(self, repeated: np.ndarray, hot: np.ndarray) -> tuple[np.ndarray, ...]:
        """(text, first window, number of windows, shard key, string key) of segments with a repeated anchor."""
        at = np.searchsorted(self.distinct, self.anchor)
        held = repeated[at]
        fine = held & hot[at]
        cold = held & ~fine
        windows = expand(self.first[fine], self.count[fine])
        text = np.concatenate([self.text[cold], np.repeat(self.text[fine], self.count[fine])])
        first = np.concatenate([self.first[cold], windows])
        count = np.concatenate([self.count[cold], np.ones(len(windows), dtype=np.int64)])
        order = np.argsort(first, kind="stable")
        key = np.empty(len(first), dtype=np.uint64)
        key[order] = _span_hashes(self.data, first[order], (first + count + WIDTH - 1)[order])
        shard = mix(np.concatenate([self.anchor[cold] + U64(1), key[cold.sum() :]]))
        return text, first, count, shard, key

    def distinct_segments(self, repeated: np.ndarray, hot: np.ndarray, n_shards: int) -> tuple[np.ndarray, ...]:
        """Segments with a repeated anchor, equal ones together by id: (first window, number of windows, id); and of the distinct
        ones, by shard and key, (where they begin there, where they end, shard)."""
        text, first, count, shard, key = self.segments(repeated, hot)
        ids = self.ids[text]
        order = np.lexsort((ids, key))
        opens = np.flatnonzero(np.append(True, key[order[1:]] != key[order[:-1]])) if len(order) else order
        shard = (shard[order[opens]] % U64(n_shards)).astype(np.int64)
        by_shard = np.argsort(shard, kind="stable")
        return first[order], count[order], ids[order], opens[by_shard], np.append(opens[1:], len(order))[by_shard], shard[by_shard]


ANCHORS, SEGMENTS, ANSWERS = 0, 1, 2


def _send_anchors(n_parts: int):
    def run(table: pa.Table) -> pa.Table:
        block = Block(_in_order(table))
        order = np.lexsort((block.text, block.anchor))
        anchor, text = block.anchor[order], block.text[order]
        pair = np.ones(len(anchor), dtype=bool)
        pair[1:] = (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])
        distinct, docs = np.unique(anchor[pair], return_counts=True)
        number = block_number(table)
        return routed([(part, number, ANCHORS, pack(anchor=steps(own, KEY), docs=docs[at].astype(np.uint32))) for part, own, at in by_range(distinct, n_parts, KEY)])

    return tidy(run)


def _flags(repeated: np.ndarray, hot: np.ndarray) -> bytes:
    return pack(repeated=np.packbits(repeated), hot=np.packbits(hot))


def _from_flags(blob: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
    repeated, hot = (np.unpackbits(x, count=n).astype(bool) for x in unpack(blob, "u1", "u1"))
    return repeated, hot


def _answer_anchors(table: pa.Table) -> pa.Table:
    """Which anchors of each block occur in two documents, and which in very many: a bit for each, in the order of the block's anchors."""
    blobs = [(from_steps(a, KEY), docs) for a, docs in (unpack(b, "u1", "<u4") for b in table.column("blob").to_pylist())]
    every = np.concatenate([b[0] for b in blobs])
    distinct, inverse = np.unique(every, return_inverse=True)
    docs = np.bincount(inverse, weights=np.concatenate([b[1] for b in blobs])).astype(np.int64)
    rows, at = [], 0
    for part, number, (anchor, _) in zip(table.column("to").to_pylist(), table.column("block").to_pylist(), blobs):
        total = docs[inverse[at : at + len(anchor)]]
        at += len(anchor)
        rows.append((part, number, ANCHORS, _flags(total > 1, total > HOT)))
    return routed(rows)


def _repeated(block: Block, answers: pa.Table, n_parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the block's distinct anchors, which are repeated and which are hot; each part has answered for its range."""
    blobs = dict(zip(answers.column("to").to_pylist(), answers.column("blob").to_pylist()))
    own = [_from_flags(blobs[part], len(keys)) for part, keys, _ in by_range(block.distinct, n_parts, KEY)]
    return tuple(np.concatenate([x[k] for x in own]) if own else np.zeros(0, dtype=bool) for k in range(2))


def _send_segments(n_parts: int, n_shards: int):
    """Of each part the block's segments, shard by shard, with the number in each of the part's shards."""
    per_part = n_shards // n_parts

    def run(texts: pa.Table, answers: pa.Table) -> pa.Table:
        if not texts.num_rows or not answers.num_rows:
            return routed([])
        block, number = Block(_in_order(texts)), block_number(texts)
        repeated, hot = _repeated(block, answers, n_parts)
        if not repeated.any():
            return routed([])
        first, count, ids, opens, ends, own_shard = block.distinct_segments(repeated, hot, n_shards)
        low, high = ids[opens], ids[ends - 1]
        # what is known of the block's own anchors goes along, so that it comes back with the answers
        rows = [(number % n_parts, number, ANCHORS, _flags(repeated, hot))]
        for part, own in by_part(own_shard // per_part):
            windows = count[opens[own]]
            strings = block.data[expand(first[opens[own]], windows + WIDTH - 1)]
            each = np.bincount(own_shard[own] % per_part, minlength=per_part).astype("<u4")
            rows.append((part, number, SEGMENTS, pack(each=each, windows=windows.astype("<u4"), low=planes(low[own]), more=planes(high[own] - low[own]), strings=strings)))
        return routed(rows)

    return tidy(run)


def smallest_ids(strings: np.ndarray, windows: np.ndarray, low: np.ndarray) -> np.ndarray:
    """For the windows of all segments, in order, the smallest id of a segment that holds the window."""
    length = windows + WIDTH - 1
    ends = np.cumsum(length + 1)
    starts = ends - length - 1
    spaced = np.zeros(int(ends[-1]), dtype=np.uint16)
    data = np.zeros(len(spaced), dtype=np.uint8)
    slots = expand(starts, length)
    spaced[slots] = strings.astype(np.uint16) + np.uint16(1)
    data[slots] = strings
    order = suffix_array(spaced, 257)
    is_window = np.zeros(len(spaced), dtype=bool)
    places = expand(starts, windows)
    is_window[places] = True
    owner = np.zeros(len(spaced), dtype=np.int32)
    owner[places] = np.repeat(np.arange(len(windows)), windows)
    order = order[is_window[order]].astype(np.int64)
    opens = common_prefixes(data, order, WIDTH) < WIDTH
    opens[0] = True
    least = np.minimum.reduceat(low[owner[order]], np.flatnonzero(opens))
    by_place = np.zeros(len(spaced), dtype=np.int64)
    by_place[order] = least[np.cumsum(opens) - 1]
    return by_place[places]


def _answer_segments(table: pa.Table) -> pa.Table:
    """A part's shards one after the other; to each block, what its segments' windows have in smaller ids."""
    rows, entries, part = [], [], table.column("to")[0].as_py()
    for number, kind, blob in zip(table.column("block").to_pylist(), table.column("kind").to_pylist(), table.column("blob").to_pylist()):
        if kind == ANCHORS:
            rows.append((0, number, ANCHORS, blob))
        else:
            each, windows, low, more, strings = unpack(blob, "<u4", "<u4", "u1", "u1", "u1")
            low, windows = from_planes(low).view(np.int64), windows.astype(np.int64)
            ends, bytes_ = np.cumsum(np.append(0, each.astype(np.int64))), np.cumsum(np.append(0, windows + WIDTH - 1))
            entries.append((number, ends, bytes_, windows, low, low + from_planes(more).view(np.int64), strings))
    found: dict[int, list] = {}
    for shard in range(len(entries[0][1]) - 1 if entries else 0):
        held = []
        for number, ends, bytes_, *arrays, strings in entries:
            a, b = ends[shard], ends[shard + 1]
            if b > a:
                held.append((np.arange(a, b), np.full(b - a, number), *[x[a:b] for x in arrays], strings[bytes_[a] : bytes_[b]]))
        if held:
            place, *arrays = (np.concatenate(x) for x in zip(*held))
            for number, entry, offset, run, least in _answers_of(*arrays):
                found.setdefault(number, []).append((place[entry], offset, arrays[1][entry] - run, least))
    for number, parts in found.items():
        place, offset, rest, least = (np.concatenate(x) for x in zip(*parts))  # places ascend, as shards and their entries do
        rows.append((part, number, ANSWERS, pack(place=steps(place.astype(np.uint64), 4), offset=offset.astype("<u4"), rest=rest.astype("<u4"), least=planes(least))))
    return routed(rows)


def _answers_of(number: np.ndarray, windows: np.ndarray, low: np.ndarray, high: np.ndarray, strings: np.ndarray) -> Iterator[tuple]:
    """For each block of a shard: (block, numbers of the segments, first windows, numbers of windows, smaller ids) in runs."""
    length = windows + WIDTH - 1
    begins = np.cumsum(length) - length
    key = _span_hashes(strings, begins, begins + length)
    distinct, pick, inverse = np.unique(key, return_index=True, return_inverse=True)
    least = np.full(len(distinct), NO_ID, dtype=np.int64)
    np.minimum.at(least, inverse, low)
    # a segment that shares its anchor with no other has no window in common with one, so there is nothing to sort it against
    ids = np.repeat(least, windows[pick])
    several = _with_others(strings, begins[pick])
    if several.any():
        own = pick[several]
        ids[np.repeat(several, windows[pick])] = smallest_ids(strings[expand(begins[own], length[own])], windows[own], least[several])
    first = np.cumsum(windows[pick]) - windows[pick]
    # runs of windows of an entry with one smaller id
    value = ids[expand(first[inverse], windows)]
    entry = np.repeat(np.arange(len(key)), windows)
    offset = expand(np.zeros(len(key), dtype=np.int64), windows)
    use = value < high[entry]
    value, entry, offset = value[use], entry[use], offset[use]
    if not len(value):
        return
    opens = np.ones(len(value), dtype=bool)
    opens[1:] = (entry[1:] != entry[:-1]) | (value[1:] != value[:-1]) | (offset[1:] != offset[:-1] + 1)
    at = np.flatnonzero(opens)
    run = np.diff(np.append(at, len(value)))
    entry, value, offset = entry[at], value[at], offset[at]
    for block, own in by_part(number[entry]):
        yield block, entry[own], offset[own], run[own], value[own]


def _whole_characters(data: np.ndarray, gone: np.ndarray) -> np.ndarray:
    """The bytes that go where characters cut in part go whole."""
    leads = np.flatnonzero((data & 0xC0) != 0x80)
    if not len(leads) or leads[0]:
        leads = np.append(0, leads)
    return np.repeat(np.logical_or.reduceat(gone, leads), np.diff(np.append(leads, len(data))))


def _cut(kept: list[str], with_text: bool, n_parts: int, n_shards: int):
    def run(texts: pa.Table, answers: pa.Table) -> pa.Table:
        texts = _in_order(texts)
        block = Block(texts) if answers.num_rows else None
        if block:
            gone = _removed(block, answers, n_parts, n_shards)
            raw, starts, data = block.texts, block.starts, block.data
        else:
            raw = [x or b"" for x in texts.column("__text").to_pylist()]
        columns = {c: texts.column(c) for c in kept}
        out: dict[str, list] = {"n_bytes": [], "n_removed": [], "n_spans": [], "kept_sha256": [], "kept": [], "kept_text": []}
        for k, text in enumerate(raw):
            removed, spans, own, whole = 0, 0, len(text), text
            if block and (mine := gone[starts[k] : starts[k + 1] - 1]).any():
                bytes_ = data[starts[k] : starts[k + 1] - 1]
                removed, spans, text = int(mine.sum()), int(mine[0]) + int((mine[1:] & ~mine[:-1]).sum()), bytes_[~mine].tobytes()
                whole = bytes_[~_whole_characters(bytes_, mine)].tobytes() if with_text else b""
            for name, x in zip(out, (own, removed, spans, hashlib.sha256(text).hexdigest(), text, whole)):
                if with_text or not name.startswith("kept_t") and name != "kept":
                    out[name].append(x)
        if not with_text:
            del out["kept"], out["kept_text"]
        return pa.table(columns | out)

    return tidy(run)


def _removed(block: Block, answers: pa.Table, n_parts: int, n_shards: int) -> np.ndarray:
    """Which bytes of a block go."""
    gone = np.zeros(len(block.data) + 1, dtype=np.int32)
    rows = list(zip(*[answers.column(c).to_pylist() for c in ("to", "kind", "blob")]))
    blobs = {part: blob for part, kind, blob in rows if kind == ANSWERS}
    if blobs:
        first, count, ids, opens, ends, shard = block.distinct_segments(*_from_flags(*[b for _, k, b in rows if k == ANCHORS], len(block.distinct)), n_shards)
        for part, own in by_part(shard // (n_shards // n_parts)):
            if part not in blobs:
                continue
            place, offset, rest, least = unpack(blobs[part], "u1", "<u4", "<u4", "u1")
            segment, least = own[from_steps(place, 4).astype(np.int64)], from_planes(least).view(np.int64)
            run = count[opens[segment]] - rest
            n = ends[segment] - opens[segment]
            at = expand(opens[segment], n)
            of = np.repeat(np.arange(len(segment)), n)
            use = least[of] < ids[at]
            at, of = at[use], of[use]
            begins = first[at] + offset[of]
            np.add.at(gone, begins, 1)
            np.add.at(gone, begins + run[of] + WIDTH - 1, -1)
    return np.cumsum(gone[:-1]) > 0


def remove_repeats(documents: DataFrame, *, doc_id: str = "doc_id", text: str = "text", with_text: bool = False, block_bytes: int = 4 << 20, shard_bytes: int = 2 << 20, part_bytes: int = 64 << 20) -> DataFrame:
    """Add to each document `n_bytes`, `n_removed`, `n_spans` (maximal removed runs), `kept_sha256`, and with
    `with_text` the remaining bytes as `kept` binary, and as `kept_text` what remains where characters that are cut in
    part go whole. Columns of those names, in any case of letters, are replaced.

    A shard holds what comes of about `shard_bytes` of text at most; a part is a task's row of shards.
    """
    added = T.StructType.fromDDL("n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary, kept_text binary" * with_text)
    documents, renamed = set_aside(documents, "__block", "__id", "__text")
    doc_id, text = renamed.get(doc_id, doc_id), renamed.get(text, text)
    fields = [f for f in documents.schema.fields if f.name.lower() not in {*added.names, "kept", "kept_text", text.lower()}]
    blocked, n_bytes = blocks_of(documents, [f.name for f in fields], doc_id, text, block_bytes)
    n_parts = parts_for(documents.sparkSession, n_bytes, part_bytes)
    n_shards = n_parts * max(1, -(-n_bytes // (shard_bytes * n_parts)))
    grouped = blocked.groupBy("__block")
    anchors = grouped.applyInArrow(_send_anchors(n_parts), ROUTED_DDL).groupBy("to").applyInArrow(tidy(_answer_anchors), ROUTED_DDL)
    segments = grouped.cogroup(anchors.groupBy("block")).applyInArrow(_send_segments(n_parts, n_shards), ROUTED_DDL)
    answers = segments.groupBy("to").applyInArrow(tidy(_answer_segments), ROUTED_DDL)
    cut = grouped.cogroup(answers.groupBy("block")).applyInArrow(_cut([f.name for f in fields], with_text, n_parts, n_shards), T.StructType(fields + added.fields))
    return given_back(cut, renamed)
