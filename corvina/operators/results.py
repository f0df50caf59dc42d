"""Results of questions as an appended table, and the first usable of several readings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def append_results(log: DataFrame | None, new: DataFrame, question: str, key: str, value: str) -> DataFrame:
    """``log`` with the rows of ``new`` behind it: (question, key, value, detalhes), all other columns as JSON in ``detalhes``."""
    rest = [c for c in new.columns if c not in (question, key, value)]
    rows = new.select(question, key, value, F.to_json(F.struct(*rest)).alias("detalhes"))
    return rows if log is None else log.unionByName(rows)


def latest_results(log: DataFrame, question: str, key: str) -> DataFrame:
    """The row of the greatest ``key`` for each question."""
    return log.groupBy(question).agg(F.max_by(F.struct(*[c for c in log.columns if c != question]), key).alias("r")).select(question, "r.*")


def read_details(log: DataFrame, schema: str, details: str = "detalhes") -> DataFrame:
    """``log`` with its JSON details as columns; what is no JSON of the schema gives nulls."""
    return log.withColumn("d_", F.from_json(details, schema)).select(*[c for c in log.columns if c != details], "d_.*")


def first_long(rows: DataFrame, readings: list[str], least: int) -> DataFrame:
    """``rows`` with ``text`` and ``source``: the first reading of at least ``least`` characters; rows without one are left out."""
    found = F.coalesce(*[F.when(F.length(c) >= least, F.struct(F.col(c).alias("text"), F.lit(c).alias("source"))) for c in readings])
    return rows.withColumn("found_", found).where(F.col("found_").isNotNull()).select(*rows.columns, "found_.text", "found_.source")
