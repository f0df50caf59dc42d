"""State of the work queue as frames: what an insert, update or delete leaves behind."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def insert_or_ignore(old: DataFrame, new: DataFrame, unique: str, first: str) -> DataFrame:
    """Rows of ``new`` that a table with a unique column takes: unknown there, the least ``first`` of each value; nulls never clash."""
    named = new.where(F.col(unique).isNotNull())
    least = named.groupBy(F.col(unique).alias("u_")).agg(F.min(first).alias("f_"))
    fresh = named.join(least, (F.col(unique) == F.col("u_")) & (F.col(first) == F.col("f_")), "left_semi").join(old.select(unique).distinct(), unique, "left_anti")
    return fresh.select(*new.columns).unionByName(new.where(F.col(unique).isNull()))


def admit_articles(articles: DataFrame, key: str = "id", uniques: tuple[str, ...] = ("url_id", "url", "hash_conteudo")) -> DataFrame:
    """``articles`` with ``situacao``: extraido, or duplicado where an admitted earlier row has one of the unique values.

    Each unique column is settled after the one before, the least key winning;
    null values never clash, and are kept out of the shuffle.
    """
    left = articles.select(key, *uniques)
    for u in uniques:
        won = left.where(F.col(u).isNotNull()).groupBy(u).agg(F.min_by(F.struct(*left.columns), key).alias("w_")).select("w_.*")
        left = won.unionByName(left.where(F.col(u).isNull()))
    kept = left.select(F.col(key).alias("kept_"))
    return articles.join(kept, articles[key] == F.col("kept_"), "left").withColumn("situacao", F.when(F.col("kept_").isNull(), "duplicado").otherwise("extraido")).drop("kept_")


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``old`` with the rows of ``new`` in place of those of the same key; nulls of ``new`` keep the old value."""
    o = old.select(*[F.col(c).alias(f"o_{c}") for c in old.columns])
    n = new.select(*[F.col(c).alias(f"n_{c}") for c in old.columns])
    return o.join(n, F.col(f"o_{key}") == F.col(f"n_{key}"), "full").select(*[F.coalesce(f"n_{c}", f"o_{c}").alias(c) for c in old.columns])


def replace_children(old: DataFrame, new: DataFrame, parent: str) -> DataFrame:
    """Child rows after those of the parents in ``new`` were replaced."""
    return old.join(new.select(parent).distinct(), parent, "left_anti").select(*old.columns).unionByName(new.select(*old.columns))


def restore_axis(articles: DataFrame, urls: DataFrame, axes: list[str]) -> DataFrame:
    """``articles`` with the axis of their address row where that is a known one and theirs differs; null axes stay null here."""
    known = urls.where(F.col("eixo_tematico").isin(axes)).select(F.col("id").alias("u_"), F.col("eixo_tematico").alias("axis_"))
    joined = articles.join(known, articles["url_id"] == F.col("u_"), "left")
    return joined.select(*[F.when(F.col("axis_").isNotNull() & (F.col("eixo_tematico") != F.col("axis_")), F.col("axis_")).otherwise(F.col("eixo_tematico")).alias(c) if c == "eixo_tematico" else F.col(c) for c in articles.columns])


def fill_axis(articles: DataFrame, by_address: Column) -> DataFrame:
    """``articles`` with null axes taken from their address; the second step of the repair after :func:`restore_axis`."""
    return articles.withColumn("eixo_tematico", F.coalesce("eixo_tematico", by_address))


def set_status(queue: DataFrame, keys: DataFrame, status: str, key: str = "id", column: str = "status_extracao") -> DataFrame:
    """``queue`` with ``status`` in the rows whose key stands in ``keys``."""
    named = keys.select(F.col(keys.columns[0]).alias("k_")).where("k_ is not null").distinct()
    joined = queue.join(named, queue[key] == F.col("k_"), "left")
    return joined.select(*[F.when(F.col("k_").isNotNull(), F.lit(status)).otherwise(F.col(c)).alias(c) if c == column else F.col(c) for c in queue.columns])


def reset_status(queue: DataFrame, old: str, new: str, rows: Column, column: str = "status_extracao") -> DataFrame:
    """``queue`` with status ``old`` set to ``new`` in the rows that a condition picks."""
    return queue.withColumn(column, F.when((F.col(column) == old) & rows, new).otherwise(F.col(column)))


def sound_articles(articles: DataFrame, title: str = "titulo", body: str = "corpo", least: int = 150) -> DataFrame:
    """Articles with a title and a body of at least ``least`` characters; what deleting the invalid ones leaves."""
    return articles.where(F.col(title).isNotNull() & (F.length(body) >= least))


def clear_small_events(articles: DataFrame, event: str = "evento_id", least: int = 2) -> DataFrame:
    """``articles`` with event -1 where an event has fewer than ``least`` articles; ``least`` null clears all."""
    if least is None:
        return articles.withColumn(event, F.lit(-1).cast("long"))
    large = articles.where(F.col(event) >= 0).groupBy(F.col(event).alias("e_")).agg(F.count("*").alias("n_")).where(F.col("n_") >= least).select("e_")
    joined = articles.join(large, articles[event] == F.col("e_"), "left")
    return joined.select(*[F.coalesce("e_", F.lit(-1)).alias(c) if c == event else F.col(c) for c in articles.columns])
