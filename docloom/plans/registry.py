"""Registry of named queries: a function of (spark, sf_dir) and the SQL that states its result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, ctes: tuple[str, ...] = (), recursive: bool = False) -> Callable[[Query], Query]:
    """Register a query; ``ctes`` are the carriers that its SQL starts from."""

    def put(f: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"two queries named {name}")
        QUERIES[name] = f
        if sql is not None:
            body = sql.strip()
            head = ", ".join(ctes)
            if head:
                head = ("WITH RECURSIVE " if recursive else "WITH ") + head
                body = head + (", " + body[5:] if body.startswith("WITH ") else " " + body)
            ORACLES[name] = body
        return f

    return put
