"""Vectors in columns: blobs of float32, unit length, and the nearest of few anchors."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, FloatType


@F.pandas_udf(BinaryType())
def to_blob(vectors: pd.Series) -> pd.Series:
    """Little-endian float32 bytes of a vector."""
    return vectors.map(lambda v: np.asarray(v, "<f4").tobytes(), na_action="ignore")


@F.pandas_udf(ArrayType(FloatType()))
def from_blob(blobs: pd.Series) -> pd.Series:
    """The vector of little-endian float32 bytes; bytes that are no multiple of four give null."""
    return blobs.map(lambda b: np.frombuffer(b, "<f4") if len(b) % 4 == 0 else None, na_action="ignore")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(vector: Column) -> Column:
    """A vector at length one; the zero vector stays."""
    length = F.sqrt(dot(vector, vector))
    return F.get(F.transform(F.array(F.when(length == 0, 1.0).otherwise(length)), lambda n: F.transform(vector, lambda x: x.cast("double") / n)), F.lit(0))


def centroids(vectors: DataFrame, vector: str, label: str) -> DataFrame:
    """(anchor, centroid): the unit mean of the unit vectors of each label; one row a label."""
    placed = vectors.where(F.col(label).isNotNull() & F.col(vector).isNotNull()).select(F.col(label).alias("anchor"), F.posexplode(unit(F.col(vector))).alias("i", "x"))
    means = placed.groupBy("anchor", "i").agg(F.avg("x").alias("m"))
    return means.groupBy("anchor").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda p: p["m"]).alias("m")).select("anchor", unit(F.col("m")).alias("centroid"))


def nearest_anchor(vectors: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """``vectors`` (key, label) with the anchor of the greatest cosine, the least anchor in a tie, and that cosine.

    All centroids, one a label, travel with each row as one array.
    """
    anchors = F.broadcast(centroids(vectors, vector, label).agg(F.array_sort(F.collect_list(F.struct("anchor", "centroid"))).alias("anchors")))
    scored = vectors.select(key, label, unit(F.col(vector)).alias("u_")).crossJoin(anchors)
    best = F.array_max(F.transform("anchors", lambda a: F.struct(F.round(dot(F.col("u_"), a["centroid"]), 9).alias("s"), (-a["anchor"]).alias("minus"), a["anchor"].alias("anchor"), dot(F.col("u_"), a["centroid"]).alias("similarity"))))
    return scored.select(key, label, best.alias("b")).select(key, label, "b.anchor", "b.similarity")
