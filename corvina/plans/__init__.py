"""Queries over the project's tables, and the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corvina.plans import archive, questions, timestamps, topics, upkeep


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    # Each module of plans enters its queries into one table.
    assert questions and topics and upkeep
    return archive.QUERIES | {f.__name__: f for f in timestamps.QUERIES}


def oracle_sql() -> dict[str, str]:
    return dict(archive.SQL)
