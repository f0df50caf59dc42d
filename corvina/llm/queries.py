"""Queries of the problems on training text, over the project's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvina.llm.boilerplate import furniture_lines
from corvina.llm.leakage import leak_report, leaked_items, without_leaks
from corvina.llm.mixture import mix
from corvina.llm.names import name_pairs, same_names
from corvina.llm.neardup import duplicate_links, near_duplicates, row_pairs
from corvina.llm.oracle import SQL
from corvina.llm.repeated import repeated_lines
from corvina.llm.residue import residue_rows
from corvina.llm.spam import spam_pages
from corvina.llm.truncation import truncated, truncation_report
from corvina.session import hinted, stash
from corvina.tables import table


def _sound(spark: SparkSession, folder: str) -> DataFrame:
    """materias without residue and error pages."""
    rows = table(spark, folder, "materias")
    residue = stash(residue_rows(rows).select(F.col("key").alias("id")))
    return rows.join(hinted(residue), "id", "left_anti")


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return truncated(_sound(spark, folder)).where("cut").select(F.col("key").alias("id")).distinct()


def p1_report(spark: SparkSession, folder: str) -> DataFrame:
    return truncation_report(table(spark, folder, "materias"), truncated(_sound(spark, folder))).withColumnRenamed("source", "veiculo_id")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    # The stated half, less what a line of furniture taken for text may change; no pair lies near.
    return row_pairs(*duplicate_links(_sound(spark, folder), width=3, similarity=0.48))


def p3_groups(spark: SparkSession, folder: str) -> DataFrame:
    """One row per document: five words, 0.8, as for training text in general."""
    rows, _ = near_duplicates(_sound(spark, folder))
    return rows.select(F.col("key").alias("id"), F.col("class").alias("classe"), F.col("group").alias("grupo"), "n_links")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return furniture_lines(_sound(spark, folder)).select(F.col("key").alias("id"), "linha")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return residue_rows(table(spark, folder, "materias")).select(F.col("key").alias("id"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    pairs = name_pairs(same_names(table(spark, folder, "materias")))
    return pairs.select(F.col("source").alias("veiculo_id"), F.col("name_a").alias("autor_a"), F.col("name_b").alias("autor_b"))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return repeated_lines(table(spark, folder, "materias")).select(F.col("key").alias("id"), "linha")


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return leaked_items(table(spark, folder, "documents"), table(spark, folder, "itens_avaliacao")).select("doc_id", "item_id")


def p8_report(spark: SparkSession, folder: str) -> DataFrame:
    items = table(spark, folder, "itens_avaliacao")
    return leak_report(leaked_items(table(spark, folder, "documents"), items), items)


def p8_clean(spark: SparkSession, folder: str) -> DataFrame:
    """documents without the leaked passages: how many words each lost and keeps."""
    docs = table(spark, folder, "documents")
    cleaned = without_leaks(docs, table(spark, folder, "itens_avaliacao"))
    return cleaned.select("doc_id", "n_words", "n_removed", F.length("text").alias("n_chars"))


#: Where the public tokenizers lie; a parameter of the operator.
TOKENS = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def p9_mix(spark: SparkSession, folder: str) -> DataFrame:
    return mix(table(spark, folder, "documents"), table(spark, folder, "pesos_mistura"), TOKENS)[0]


def p9_mix_all(spark: SparkSession, folder: str) -> DataFrame:
    """As many tokens as the listed sources hold: short sources repeat their documents up to their caps."""
    return mix(table(spark, folder, "documents"), table(spark, folder, "pesos_mistura"), TOKENS, all_tokens=True)[0]


def p9_selected(spark: SparkSession, folder: str) -> DataFrame:
    return mix(table(spark, folder, "documents"), table(spark, folder, "pesos_mistura"), TOKENS)[1]


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    return spam_pages(table(spark, folder, "documents")).where("spam").select(F.col("key").alias("doc_id"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_report, p3_found, p3_groups, p4_found, p5_found, p6_found, p7_found, p8_found, p8_report, p8_clean, p9_mix, p9_mix_all, p9_selected, p10_found)}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
