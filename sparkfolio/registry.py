"""The queries of every operator family and their SQL, gathered by name."""

from __future__ import annotations

from .queries import accounts, base, books, edge, family, inference, live, market, scalars, sources  # noqa: F401


def queries() -> dict:
    return dict(base.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(base.SQL)
