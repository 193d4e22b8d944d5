"""Where queries register under their names, with the SQL that checks them."""

from __future__ import annotations

from shelfline.plans import sql as S

_QUERIES: dict = {}
_SQL: dict[str, str] = {}


def query(names: str | None = None, sql: str | None = None):
    """Registers a query under its function's name, with SQL over the adapters `names` if there is any."""

    def add(f):
        if f.__name__ in _QUERIES:
            raise ValueError(f"two queries are called {f.__name__}")
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = S.using(names or "", sql)
        return f

    return add


def with_ctes(names: str, ctes: str, select: str) -> tuple[str, str]:
    """SQL of adapters and further CTEs."""
    return names, ", " + ctes + "\n" + select


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
