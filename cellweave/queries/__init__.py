"""Queries over the benchmark tables, one per operator, each with DuckDB SQL for the same result where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None


def all_queries() -> dict[str, Query]:
    from cellweave.queries import catalog, files, records, regions, reshape, sections, trade

    found: dict[str, Query] = {}
    for module in (files, reshape, sections, catalog, regions, trade, records):
        found.update(module.QUERIES)
    return found
