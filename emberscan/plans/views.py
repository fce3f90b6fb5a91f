"""Pixel, file and detection views over the ``events`` table, for the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


PIXEL_COLUMNS = """
    event_id {div} 1600 AS granule_key, CAST((event_id % 1600) {div} 40 AS INT) AS "row", CAST(event_id % 40 AS INT) AS col,
    CAST((event_id % 40) * 80 AS INT) AS swath_col,
    27.5e0 + ((event_id * 7919) % 2150) / 100e0 AS latitude, -111e0 + ((event_id * 104729) % 3500) / 100e0 AS longitude,
    95e0 + event_id % 20 AS solar_zenith,
    value * 0.2e0 AS M07, value * 0.5e0 AS M08, value AS M10, value * 0.8e0 AS M11,
    CASE WHEN event_id % 13 <> 0 THEN value * 0.35e0 + ((event_id * 7919) % 1000) / 10e0 END AS M12,
    CASE WHEN event_id % 17 <> 0 THEN value * 0.35e0 + ((event_id * 104729) % 1000) / 10e0 END AS M13,
    value * 0.1e0 AS M14, ts
"""


def _columns(text: str) -> list[str]:
    """Top-level comma split of a select list, in Spark's dialect."""
    out, depth, part = [], 0, ""
    for ch in text.replace('"', "`").replace("{div}", "div"):
        depth += {"(": 1, ")": -1}.get(ch, 0)
        if ch == "," and not depth:
            out.append(part.strip())
            part = ""
        else:
            part += ch
    return [*out, part.strip()]


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).selectExpr(*_columns(PIXEL_COLUMNS))


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detection table in its enriched form."""
    site = F.expr("CASE WHEN user_id < 10 THEN user_id ELSE user_id * 16 + event_id % 16 END")
    ok = F.col("event_id") % 23 != 0
    base = events(spark, sf_dir).select("*", site.alias("site"))
    base = base.select(
        F.col("ts").alias("datetime_utc"),
        F.expr("27.5e0 + ((site * 7919) % 2150) / 100e0 + (event_id % 3) * 0.001e0").alias("latitude"),
        F.expr("-111e0 + ((site * 104729) % 3500) / 100e0 + (event_id % 2) * 0.001e0").alias("longitude"),
        F.lit(None).cast("string").alias("basin"),
        F.expr("cast(event_id div 1600 as string)").alias("granule"),
        F.expr("cast((event_id % 1600) div 40 as int)").alias("row"),
        F.expr("cast(event_id % 40 as int)").alias("col"),
        F.when(ok, F.expr("450.5e0 + (event_id * 7919) % 1900")).alias("temperature_K"),
        F.when(ok, F.expr("value / 10e0")).alias("radiant_heat_MW"),
    )
    base = base.withColumn("source_area_m2", F.col("radiant_heat_MW") * 1e6 / C.exitance(F.col("temperature_K")))
    from ..operators.analytics import enrich

    return enrich(base.withColumn("classification", C.source_class(F.col("temperature_K"))))
