"""Registered queries: a Spark callable and, where SQL can say it, its check query."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from dwellmatch.plans.sqltext import with_ctes

Run = Callable[[SparkSession, str], DataFrame]
RUNS: dict[str, Run] = {}
CHECKS: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Run], Run]:
    """Register the decorated function; ``sql`` may use the shared CTE names."""

    def add(run: Run) -> Run:
        RUNS[name] = run
        if sql is not None:
            CHECKS[name] = with_ctes(sql)
        return run

    return add
