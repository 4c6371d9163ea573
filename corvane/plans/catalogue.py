"""Registry of the library's queries over the bundled tables, each with its SQL counterpart."""

from __future__ import annotations

from collections.abc import Callable

_QUERIES: dict[str, Callable] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query; `sql` is DuckDB SQL that returns the same rows, None where SQL cannot."""

    def put(f):
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return put


def _load() -> None:
    from importlib import import_module

    for name in ("detector", "manifests", "joins", "corpus", "signals", "reports", "front", "files"):
        import_module(f"{__package__}.{name}")


def queries() -> dict[str, Callable]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
