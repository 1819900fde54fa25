"""Where queries are registered: name, inventory ids, callable, checking SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Registered:
    ids: str
    run: Query
    sql: str | None


QUERIES: dict[str, Registered] = {}


def query(ids: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function under its own name."""

    def register(run: Query) -> Query:
        if run.__name__ in QUERIES:
            raise ValueError(f"{run.__name__} is registered twice")
        QUERIES[run.__name__] = Registered(ids, run, sql)
        return run

    return register
