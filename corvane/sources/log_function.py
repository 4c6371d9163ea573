"""`log_lines` for SQL: a table function over the lines of logs, in Arrow batches, with bad lines as rows of their own.

    log_lines(TABLE(SELECT log, line, value FROM ...))

gives (log, line, kind, file, source, text): `utterance` rows with all fields; `header` rows with a key as `file` and its value as `text`;
and `bad` rows with the line as `text`. Blank and null lines give no row, the columns of the input may come in any order, and
an input without rows gives none. The grammar is that of `logs`.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession
from pyspark.sql.functions import arrow_udtf

from .logs import HEADER, LINE

SCHEMA = "log string, line long, kind string, file string, source string, text string"
_ARROW = pa.schema([("log", pa.string()), ("line", pa.int64()), ("kind", pa.string()), ("file", pa.string()), ("source", pa.string()), ("text", pa.string())])


def _named(pattern: str, *names: str) -> str:
    """The pattern with its groups named, as Arrow wants them."""
    for n in names:
        pattern = pattern.replace("(", f"\0<{n}>", 1) if pattern.find("(?") != pattern.find("(") else pattern
    return pattern.replace("\0", "(?P")


_LINE, _HEADER = _named(LINE, "file", "source", "text"), _named(HEADER, "key", "text")


def parsed(log: pa.Array, line: pa.Array, value: pa.Array) -> pa.Table:
    """What `log_lines` gives for these lines."""
    blank = pc.fill_null(pc.equal(pc.utf8_length(pc.utf8_trim_whitespace(value)), 0), True)
    log, line, value = (a.filter(pc.invert(blank)) for a in (log, line, value))
    quoted = pc.starts_with(value, '"')
    # a line with `=` that does not start with a quote is a header, whatever follows
    head = pc.and_(pc.match_substring(value, "="), pc.invert(quoted))
    as_line, as_head = pc.extract_regex(value, _LINE), pc.extract_regex(value, _HEADER)
    is_line = pc.and_(pc.is_valid(as_line), pc.invert(head))
    is_head = pc.and_(pc.is_valid(as_head), head)
    none = pa.nulls(len(value), pa.string())
    pick = lambda line_, head_, bad: pc.if_else(is_line, line_, pc.if_else(is_head, head_, bad))
    field = pc.struct_field
    columns = [
        log, line, pick(pa.scalar("utterance"), pa.scalar("header"), pa.scalar("bad")), pick(field(as_line, "file"), field(as_head, "key"), none),
        pick(field(as_line, "source"), none, none), pick(field(as_line, "text"), field(as_head, "text"), value),
    ]
    return pa.table([pa.chunked_array([c]) if isinstance(c, pa.Array) else c for c in columns], schema=_ARROW)


class _LogLines:
    def eval(self, table: pa.RecordBatch) -> Iterator[pa.Table]:
        yield parsed(table.column("log").cast(pa.string()), table.column("line").cast(pa.int64()), table.column("value").cast(pa.string()))


def register(spark: SparkSession, name: str = "log_lines") -> None:
    spark.udtf.register(name, arrow_udtf(_LogLines, returnType=SCHEMA))
