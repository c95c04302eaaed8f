"""The registered queries of the moves, and their SQL."""

from __future__ import annotations

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):  # noqa: ANN201
    """Registers a query (spark, folder of the tables) under its name, with the SQL of its rows."""

    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add
