"""Sinks: delimited and JSON reports, key-value lists that grow, and trees of wave files."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_ZEROS = bytes(1 << 20)


def write_report(frame: DataFrame, folder: str, kind: str = "csv") -> None:
    """A folder of CSV or TSV (with headers), JSON lines or text (one string column) files; it replaces what is there."""
    writer = frame.write.mode("overwrite")
    if kind in ("csv", "tsv"):
        writer.option("header", True).option("sep", "," if kind == "csv" else "\t").csv(folder)
    elif kind == "json":
        writer.json(folder)
    elif kind == "text":
        writer.text(folder)
    else:
        raise ValueError(f"unknown kind of report: {kind}")


def append_key_values(pairs: DataFrame, folder: str, key: str = "key", value: str = "value", separator: str = " - ") -> None:
    """Append `key - value` lines to a folder that `tables.key_values` reads."""
    pairs.select(F.concat(F.col(key), F.lit(separator), F.col(value))).write.mode("append").text(folder)


def write_audio(frame: DataFrame, root: str, path: str = "path", content: str = "content", zeros: str | None = None) -> DataFrame:
    """(path, bytes, error): each row's content as a file under root, written under another name and renamed, so that a retried task leaves whole files.

    The column `zeros` says how many zero bytes follow the content (digital silence). They are never held: a local file gets a hole, other
    file systems get them a piece at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(root)
        local = isinstance(fs, pafs.LocalFileSystem)
        for batch in batches:
            out = []
            for name, raw, more in zip(*(batch.column(c).to_pylist() for c in "pcz")):
                try:
                    target, more = f"{base.rstrip('/')}/{name}", more or 0
                    fs.create_dir(target.rpartition("/")[0], recursive=True)
                    if local:
                        with open(f"{target}.tmp", "wb") as f:
                            f.write(raw)
                            f.truncate(len(raw) + more)
                    else:
                        with fs.open_output_stream(f"{target}.tmp", compression=None) as f:
                            f.write(raw)
                            for at in range(0, more, len(_ZEROS)):
                                f.write(_ZEROS[: more - at])
                    fs.move(f"{target}.tmp", target)
                    out.append((name, len(raw) + more, None))
                except Exception as bad:  # noqa: BLE001  errors are data here
                    out.append((name, None, f"{type(bad).__name__}: {bad}"))
            kinds = (pa.string(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else [[]] * 3, kinds)], names=["path", "bytes", "error"])

    more = F.lit(0) if zeros is None else F.col(zeros)
    return frame.select(F.col(path).alias("p"), F.col(content).alias("c"), more.cast("long").alias("z")).mapInArrow(run, "path string, bytes long, error string")
