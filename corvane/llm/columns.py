"""Columns of the caller beside those of an operator."""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def kept_fields(frame: DataFrame, *replaced: str) -> list[Column]:
    """The frame's columns but those of the given names, in any case of letters; a null column where none is left."""
    gone = {name.lower() for name in replaced}
    return [F.col(f"`{c}`") for c in frame.columns if c.lower() not in gone] or [F.lit(None).cast("int").alias("nothing")]


def set_aside(frame: DataFrame, *working: str) -> tuple[DataFrame, dict[str, str]]:
    """The frame with other names for those columns that an operator's working names would hide, and the new names by the old.

    Names are compared as Spark does, whatever their case. Where none clashes, nothing changes.
    """
    names = {w.lower() for w in working}
    taken = names | {c.lower() for c in frame.columns}
    renamed: dict[str, str] = {}
    for c in frame.columns:
        if c.lower() in names:
            renamed[c] = next(n for n in (f"{c}_{k}" for k in count()) if n.lower() not in taken)
            taken.add(renamed[c].lower())
    return (frame.withColumnsRenamed(renamed) if renamed else frame), renamed


def given_back(frame: DataFrame, renamed: dict[str, str]) -> DataFrame:
    """The frame with the names that `set_aside` changed."""
    return frame.withColumnsRenamed({new: old for old, new in renamed.items()}) if renamed else frame
