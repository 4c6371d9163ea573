"""A data source for trees of audio files that reads headers only, however long the clips are.

    spark.read.format("audio_headers").load(root)

gives a row for each .wav and .flac file under root/<speaker>/, with what its header says. The tree's folders are dealt into partitions;
tasks list their own folders and read a few ranges of each file. Equality and `in` on `speaker_id`
are pushed down and leave out whole folders. A missing root warns and is empty. A file that is no audio is a row with an error.
"""

from __future__ import annotations

import struct
import warnings
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

SCHEMA = "id string, path string, speaker_id string, bytes long, container string, subtype string, duration_sec double, sample_rate int, channels int, valid boolean, error string"
_KINDS = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.int32(), pa.int32(), pa.bool_(), pa.string()]
_ARROW = pa.schema([(column.split(" ")[0], kind) for column, kind in zip(SCHEMA.split(", "), _KINDS)])
PCM, FLOAT, EXTENSIBLE = 1, 3, 0xFFFE


def _riff(file, size: int) -> dict:
    """Walks the chunks of a wave file by their own headers, to `fmt ` and `data`."""
    at, form, n = 12, None, None
    while at + 8 <= size and (form is None or n is None):
        name, length = struct.unpack("<4sI", file.read_at(8, at))
        if name == b"fmt ":
            form = file.read_at(min(length, 40), at + 8)
        elif name == b"data":
            n = min(length, size - at - 8)
        at += 8 + length + length % 2
    if form is None or len(form) < 16 or n is None:
        raise ValueError("a wave file without format or data")
    kind, channels, rate, _, width, bits = struct.unpack("<HHIIHH", form[:16])
    if kind == EXTENSIBLE and len(form) >= 26:
        kind = struct.unpack("<H", form[24:26])[0]
    subtype = {FLOAT: "DOUBLE" if bits == 64 else "FLOAT", PCM: "PCM_U8" if bits == 8 else f"PCM_{bits}"}.get(kind, f"format {kind}")
    return {"container": "WAV", "subtype": subtype, "frames": n // width if width else 0, "sample_rate": rate, "channels": channels}


def _flac(file) -> dict:
    """The first block of a FLAC file says all."""
    head = file.read_at(26, 0)
    if len(head) < 26 or head[4] & 0x7F != 0:
        raise ValueError("a FLAC file without stream info")
    word = int.from_bytes(head[18:26], "big")
    return {"container": "FLAC", "subtype": f"PCM_{(word >> 36 & 0x1F) + 1}", "frames": word & (1 << 36) - 1, "sample_rate": word >> 44, "channels": (word >> 41 & 7) + 1}


def header(file, size: int) -> dict:
    """What a file's header says; `file` has read_at(n, offset)."""
    try:
        magic = file.read_at(min(12, size), 0)
        if magic[:4] == b"RIFF" and magic[8:12] == b"WAVE":
            found = _riff(file, size)
        elif magic[:4] == b"fLaC":
            found = _flac(file)
        else:
            raise ValueError("neither wave nor FLAC")
        frames, rate = found.pop("frames"), found["sample_rate"]
        found["duration_sec"] = round(frames / rate, 3) if rate else None
        return found | {"valid": frames > 0 and rate > 0 and found["channels"] > 0}
    except Exception as bad:  # noqa: BLE001  errors are data here
        return {"valid": False, "error": f"{type(bad).__name__}: {bad}"}


class _Folders(InputPartition):
    def __init__(self, folders: list[str]):
        self.folders = folders


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.root, self.most = options["path"], int(options.get("foldersPerPartition", "8"))
        self.extensions = tuple("." + e for e in options.get("extensions", "wav,flac").lower().split(","))
        self.speakers: set[str] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            wanted = [f.value] if isinstance(f, EqualTo) else list(f.value) if isinstance(f, In) else None
            if wanted is None or f.attribute != ("speaker_id",):
                yield f
            else:
                wanted = set(wanted)
                self.speakers = wanted if self.speakers is None else self.speakers & wanted

    def partitions(self) -> list[InputPartition]:
        system, base = fs.FileSystem.from_uri(self.root if "://" in self.root or self.root.startswith("file:/") else f"file://{self.root}")
        if system.get_file_info(base).type != fs.FileType.Directory:
            warnings.warn(f"no folder to read: {self.root}", stacklevel=2)
            return [_Folders([])]
        found = [i.path for i in system.get_file_info(fs.FileSelector(base)) if i.type == fs.FileType.Directory]
        found = sorted(p for p in found if self.speakers is None or p.rsplit("/", 1)[-1] in self.speakers)
        return [_Folders(found[k : k + self.most]) for k in range(0, len(found), self.most)] or [_Folders([])]

    def read(self, partition: _Folders) -> Iterator[pa.RecordBatch]:
        system, _ = fs.FileSystem.from_uri(self.root if "://" in self.root or self.root.startswith("file:/") else f"file://{self.root}")
        for folder in partition.folders:
            rows = []
            for info in system.get_file_info(fs.FileSelector(folder, recursive=True)):
                if info.type == fs.FileType.File and info.path.lower().endswith(self.extensions):
                    with system.open_input_file(info.path) as file:
                        found = header(file, info.size)
                    rows.append({"id": info.base_name.rsplit(".", 1)[0], "path": info.path, "speaker_id": folder.rsplit("/", 1)[-1], "bytes": info.size, **found})
            for k in range(0, len(rows), 10_000):
                yield pa.RecordBatch.from_pylist(rows[k : k + 10_000], schema=_ARROW)


class AudioHeaders(DataSource):
    @classmethod
    def name(cls) -> str:
        return "audio_headers"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def audio_headers(spark: SparkSession, root: str, **options) -> DataFrame:
    """The source's rows; registers it with the session, and lets filters reach it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(AudioHeaders)
    return spark.read.format("audio_headers").options(**{k: str(v) for k, v in options.items()}).load(root)
