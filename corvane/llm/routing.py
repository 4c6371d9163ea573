"""Exchange of packed arrays between blocks of documents and parts of a key space.

A block is a set of documents of a few megabytes. It sends one row to each part that it has keys for, a
compressed blob of arrays, and gets rows back by its number. Keys are distinct within a block before they
are sent, so a key in a third of all rows reaches its part at most once for each block.

There is a part for each shuffle partition of the session, and more only where parts would grow too large. So a
block sends at most as many rows as there are partitions, which is what a shuffle's own files come to.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .textblocks import give_back


def blocks_of(documents: DataFrame, kept: list[str], doc_id: str, text: str, block_bytes: int, **more: Column) -> tuple[DataFrame, int]:
    """Documents with their block number, id and text bytes as `__block`, `__id` and `__text`; and how many bytes of text there are."""
    raw = F.col(f"`{text}`").cast("binary")
    size = documents.agg(F.sum(F.octet_length(raw).cast("long"))).first()[0] or 0
    n = max(1, -(-size // block_bytes))
    number = F.pmod(F.xxhash64(F.col(f"`{doc_id}`").cast("long"), F.octet_length(raw)), F.lit(n)).cast("long")
    columns = [F.col(f"`{c}`") for c in kept] + [number.alias("__block"), F.col(f"`{doc_id}`").cast("long").alias("__id"), raw.alias("__text")]
    return documents.select(*columns, *[c.alias(k) for k, c in more.items()]), size


def parts_for(spark: SparkSession, n_bytes: int, part_bytes: int) -> int:
    """As many parts as the session has shuffle partitions, more where a part would stand for more than `part_bytes` of text."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_bytes // part_bytes), 1)


def tidy(f):
    """f of one table or two, with the memory that it frees handed back to the system."""

    def one(table: pa.Table) -> pa.Table:
        out = f(table)
        give_back()
        return out

    def two(texts: pa.Table, answers: pa.Table) -> pa.Table:
        out = f(texts, answers)
        give_back()
        return out

    return two if f.__code__.co_argcount == 2 else one


def pack(**arrays: np.ndarray) -> bytes:
    """Arrays as one compressed blob."""
    head = b"".join(np.array([len(a.tobytes())], dtype="<i8").tobytes() for a in arrays.values())
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(a.tobytes() for a in arrays.values()))


def unpack(blob: bytes, *kinds: str) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    sizes = np.frombuffer(raw, dtype="<i8", count=len(kinds))
    out, at = [], 8 * len(kinds)
    for size, kind in zip(sizes, kinds):
        out.append(np.frombuffer(raw, dtype=kind, count=int(size) // np.dtype(kind).itemsize, offset=at))
        at += int(size)
    return out


def by_part(part: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(part, kind="stable")
    edges = np.flatnonzero(np.diff(part[order])) + 1
    for own in np.split(order, edges) if len(order) else []:
        yield int(part[own[0]]), own


ROUTED = pa.schema([("to", pa.int64()), ("block", pa.int64()), ("kind", pa.int32()), ("blob", pa.binary())])
ROUTED_DDL = "to long, block long, kind int, blob binary"


def routed(rows: list[tuple[int, int, int, bytes]]) -> pa.Table:
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * 4, ROUTED)], schema=ROUTED)


def block_number(table: pa.Table) -> int:
    return table.column("__block")[0].as_py()


def by_range(sorted_keys: np.ndarray, n_parts: int, width: int = 8, fold: int = 1) -> Iterator[tuple[int, np.ndarray, slice]]:
    """(part, keys, where they stand) of distinct sorted hashes of `width` bytes, dealt in even ranges, so that a part's keys share their first bits; `fold` neighbours count as one part."""
    part = ((sorted_keys >> np.uint64(8 * width - 32)) * np.uint64(n_parts) >> np.uint64(32)).astype(np.int64) // fold
    edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]
    for a, b in zip(edges, edges[1:]):
        if b > a:
            yield int(part[a]), sorted_keys[a:b], slice(a, b)


def planes(keys: np.ndarray, width: int = 8) -> np.ndarray:
    """The low bytes of keys, byte by byte: the high bytes of neighbours agree, so this compresses."""
    return np.ascontiguousarray(keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).reshape(-1)


def from_planes(raw: np.ndarray, width: int = 8) -> np.ndarray:
    out = np.zeros((len(raw) // width, 8), dtype=np.uint8)
    out[:, :width] = raw.reshape(width, -1).T
    return out.reshape(-1).view("<u8")


def steps(sorted_keys: np.ndarray, width: int = 8) -> np.ndarray:
    """Sorted keys by the steps between them, whose high bytes are 0."""
    return planes(np.diff(sorted_keys, prepend=sorted_keys.dtype.type(0)), width)


def from_steps(raw: np.ndarray, width: int = 8) -> np.ndarray:
    return np.cumsum(from_planes(raw, width), dtype=np.uint64)


#: An exchange deals what it holds at most so many ways. More pieces take more exchanges, one after the other.
FAN = 512
#: Distinct keys that a later exchange gathers before it deals them on.
RUN_KEYS = 1 << 20
RUNS = pa.schema([("to", pa.int64()), ("kind", pa.int32()), ("run", pa.binary())])
RUNS_DDL = "to long, kind int, run binary"


def pieces_for(spark: SparkSession, n_bytes: int, piece_bytes: int) -> int:
    """A piece for each `piece_bytes` of text, but as many as the session has shuffle partitions where those are few."""
    return max(min(int(spark.conf.get("spark.sql.shuffle.partitions")), FAN), -(-n_bytes // piece_bytes), 1)


def _folds(n_pieces: int) -> list[int]:
    """How many neighbouring pieces each exchange treats as one; the last one tells all apart."""
    folds = [1]
    while n_pieces > FAN * folds[0]:
        folds.insert(0, folds[0] * FAN)
    return folds


def run_rows(kind: int, sorted_keys: np.ndarray, counts: np.ndarray, n_pieces: int, level: int) -> pa.RecordBatch:
    """Rows (to, kind, run) of distinct sorted keys with counts, for the exchange of that level."""
    rows = [
        (to, kind, pack(keys=steps(keys), counts=counts[at].astype("<i8")))
        for to, keys, at in by_range(sorted_keys, n_pieces, fold=_folds(n_pieces)[level])
    ]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * 3, RUNS)], schema=RUNS)


def merged(runs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct sorted keys of runs, and the sums of their counts."""
    opened = [unpack(r, "u1", "<i8") for r in runs]
    if not opened:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    keys, counts = np.concatenate([from_steps(k) for k, _ in opened]), np.concatenate([c for _, c in opened])
    order = np.argsort(keys)
    keys = keys[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, dtype=np.int64)
    return keys[first], np.add.reduceat(counts[order], first) if len(first) else counts


def dealt(runs: DataFrame, n_pieces: int) -> DataFrame:
    """Runs as `run_rows` of level 0 makes them, brought down to pieces (`to`). A slice of keys leaves at most `FAN` rows of a kind
    for each exchange, and there are as many exchanges as the number of pieces has digits to that base: rows follow bytes."""
    for level in range(1, len(_folds(n_pieces))):
        # runs for one range go to as many tasks as they fill: a task needs no whole range, it only merges what it meets
        spread = runs.repartition(F.col("to"), F.pmod(F.xxhash64("run"), F.lit(FAN)))
        runs = spread.sortWithinPartitions("to", "kind").mapInArrow(_onward(n_pieces, level), RUNS_DDL)
    return runs


def _onward(n_pieces: int, level: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, now = [], 0, None
        for batch in batches:
            for to, kind, blob in zip(*[c.to_pylist() for c in batch.columns]):
                n = len(unpack(blob, "u1", "<i8")[1])
                if held and ((to, kind) != now or size + n > RUN_KEYS):
                    yield run_rows(now[1], *merged(held), n_pieces, level)
                    held, size = [], 0
                now = (to, kind)
                held.append(blob)
                size += n
        if held:
            yield run_rows(now[1], *merged(held), n_pieces, level)
        give_back()

    return run
