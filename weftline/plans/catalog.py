"""The named queries of the library and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

_QUERIES: dict[str, Callable] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Register a function of (spark, sf_dir) as a query, with its SQL."""

    def register(make):
        key = name or make.__name__
        if key in _QUERIES:
            raise ValueError(f"two queries are named {key}")
        _QUERIES[key] = make
        if sql:
            _SQL[key] = sql
        return make

    return register


def oracle(name: str) -> str:
    """The SQL of a query registered before."""
    return _SQL[name]


def _load() -> None:
    from . import q_convo, q_evaluate, q_images, q_pii, q_relational, q_sources, q_streams, q_text, q_tokens, q_twosample, q_vectors  # noqa: F401


def queries() -> dict:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
