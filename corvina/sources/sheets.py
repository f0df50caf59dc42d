"""Marts and graphs kept as CSV, in folders or inside zip files."""

from __future__ import annotations

import csv
import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_sheet(spark: SparkSession, name: str, schema: str, folders: list[str], archive: str = "*.zip") -> DataFrame | None:
    """The CSV ``name`` of the first folder that has it, else from a zip file of the first folder that has one; None if there is none.

    Columns are taken by the names of the header, missing ones are null.
    """
    for folder in folders:
        try:
            found = spark.read.option("header", True).csv(f"{folder.rstrip('/')}/{name}")
        except AnalysisException:  # no such file here
            continue
        return _typed(found, schema)
    for folder in folders:
        try:
            packed = spark.read.format("binaryFile").load(f"{folder.rstrip('/')}/{archive}")
        except AnalysisException:
            continue
        rows = packed.select("content").mapInPandas(lambda batches: _unpacked(batches, name), "cells map<string,string>")
        wanted = _fields(spark, schema)
        typed = rows.select(*[F.try_element_at("cells", F.lit(f.name)).try_cast(f.dataType).alias(f.name) for f in wanted])
        if not typed.isEmpty():
            return typed
    return None


def _fields(spark: SparkSession, schema: str) -> StructType:
    return spark.createDataFrame([], schema).schema


def _typed(found: DataFrame, schema: str) -> DataFrame:
    wanted = _fields(found.sparkSession, schema)
    return found.select(*[(F.col(f.name) if f.name in found.columns else F.lit(None)).try_cast(f.dataType).alias(f.name) for f in wanted])


def _unpacked(batches: Iterator[pd.DataFrame], name: str) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for content in batch["content"]:
            try:
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for member in z.namelist():
                        if member.rsplit("/", 1)[-1] == name:
                            with z.open(member) as raw:
                                rows = csv.DictReader(io.TextIOWrapper(raw, "utf-8", newline=""))
                                yield pd.DataFrame({"cells": [{k: v for k, v in r.items() if k is not None} for r in rows]})
            except zipfile.BadZipFile:
                continue


#: What a node or an edge has where its table doesn't say.
NODE_DEFAULTS = {"label": None, "kind": "evento", "size": 1.0, "axis": "politico"}
EDGE_DEFAULTS = {"weight": 1.0, "distance": 1.0}


def graph_tables(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (node, label, kind, size, axis) and edges (a, b, weight, distance) with defaults for missing columns and cells.

    A node without a label is called by its number; edges to unknown nodes and
    nodes without a number are left out.
    """

    def filled(df: DataFrame, keys: list[str], defaults: dict) -> DataFrame:
        return df.where(" and ".join(f"{k} is not null" for k in keys)).select(*keys, *[F.coalesce(F.col(c) if c in df.columns else F.lit(None), F.lit(v)).alias(c) for c, v in defaults.items()])

    n = filled(nodes, ["node"], NODE_DEFAULTS).withColumn("label", F.coalesce(F.col("label").cast("string"), F.col("node").cast("string"))).dropDuplicates(["node"])
    e = filled(edges, ["a", "b"], EDGE_DEFAULTS)
    known = n.select("node")
    return n, e.join(known.withColumnRenamed("node", "a"), "a", "left_semi").join(known.withColumnRenamed("node", "b"), "b", "left_semi")
