"""The library's expressions as functions of SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Functions that SQL itself can state: name, parameters, result, body.
SCALARS = {
    "corvina_within": ("lo DATE, hi DATE, d DATE", "BOOLEAN", "d BETWEEN lo AND hi"),
    "corvina_bias": ("polarity DOUBLE, clickbait DOUBLE", "DOUBLE", "abs(polarity) + 0.5 * clickbait"),
    "corvina_tone": ("polarity DOUBLE", "STRING", "CASE WHEN polarity > 0.05 THEN 'positivo' WHEN polarity < -0.05 THEN 'negativo' ELSE 'neutro' END"),
    "corvina_content_hash": ("title STRING, body STRING", "STRING", "sha2(concat(lower(trim(coalesce(title, ''))), '|||', lower(trim(substr(coalesce(body, ''), 1, 300)))), 256)"),
}


def register(spark: SparkSession, folder: str | None = None) -> list[str]:
    """Creates the temporary SQL functions, and a view of each registered query if a folder of tables is given; the names made."""
    for name, (parameters, result, body) in SCALARS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {result} RETURN {body}")
    made = list(SCALARS)
    if folder:
        from corvina.plans import queries

        for name in ("queue_status", "outlet_report", "event_profiles", "mart_sankey"):
            view: DataFrame = queries()[name](spark, folder)
            view.createOrReplaceTempView(f"corvina_{name}")
            made.append(f"corvina_{name}")
    return made
