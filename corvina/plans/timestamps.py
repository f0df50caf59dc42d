"""Queries on the written timestamps of the project's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvina.operators.timestamps import long_values, normalise_timestamps
from corvina.session import hinted
from corvina.tables import table


def project_timestamps(spark: SparkSession, folder: str) -> DataFrame:
    """All three written fields; the clock of an outlet's seat holds where a value has no zone."""
    seats = hinted(table(spark, folder, "sedes").select(F.col("veiculo_id").alias("seat_"), "fuso"))
    rows = lambda name: (t := table(spark, folder, name)).join(seats, t["veiculo_id"] == F.col("seat_"), "left")
    order = F.unix_seconds("criado_em")
    return long_values([
        ("urls_coletadas", rows("urls_coletadas"), "id", "veiculo_id", order, [("timestamp_cdx", F.lit("UTC")), ("data_prevista", F.col("fuso"))]),
        ("materias", rows("materias"), "id", "veiculo_id", order, [("data_publicacao", F.col("fuso"))]),
    ])


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return normalise_timestamps(project_timestamps(spark, folder)).select("tabela", "campo", "id", "normal")


def p2_orders(spark: SparkSession, folder: str) -> DataFrame:
    """How many values of each outlet were read in each form."""
    return normalise_timestamps(project_timestamps(spark, folder)).groupBy(F.col("source").alias("veiculo_id"), "form").agg(F.count("*").alias("n_values"))


QUERIES = (p2_found, p2_orders)
