"""Named queries and the SQL each must agree with."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Build = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    build: Build
    sql: Callable[[], str] | None


REGISTRY: dict[str, Query] = {}


def query(name: str, sql: str | Callable[[], str] | None = None) -> Callable[[Build], Build]:
    """Register a query; ``sql`` is text, or a function where it needs the bias points."""

    def register(build: Build) -> Build:
        if name in REGISTRY:
            raise ValueError(f"query {name!r} is registered twice")
        REGISTRY[name] = Query(name, build, (lambda: sql) if isinstance(sql, str) else sql)
        return build

    return register
