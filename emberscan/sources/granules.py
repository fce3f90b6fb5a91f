"""Granule files: names, pairing, the processed log, calibration of raw counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import constants as K

RADIANCE, GEOLOCATION = "VJ102MOD", "VJ103MOD"


def list_files(spark: SparkSession, folder: str, pattern: str = "*.nc") -> DataFrame:
    """(path) of the files in a folder, found by Spark's own listing; contents are not read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path")


def describe_files(files: DataFrame) -> DataFrame:
    """(path, product, granule_key, datetime_utc) from the names alone."""
    name = C.base_name(F.col("path"))
    return files.select("path", F.substring_index(name, ".", 1).alias("product"), C.granule_key(name).alias("granule_key"), C.acquired(name).alias("datetime_utc"))


def pair_granules(radiance: DataFrame, geolocation: DataFrame, unique_left: bool = False) -> DataFrame:
    """(granule_key, rad_path, geo_path): radiance files with their geolocation file.

    Of several geolocation files of a key the greatest path counts; with
    ``unique_left`` the same holds for radiance files.
    """
    left = radiance.select(C.granule_key(C.base_name(F.col("path"))).alias("granule_key"), F.col("path").alias("rad_path"))
    right = geolocation.select(C.granule_key(C.base_name(F.col("path"))).alias("granule_key"), F.col("path").alias("p"))
    if unique_left:
        left = left.groupBy("granule_key").agg(F.max("rad_path").alias("rad_path"))
    return left.join(right.groupBy("granule_key").agg(F.max("p").alias("geo_path")), "granule_key")


def ordered_pairs(pairs: DataFrame) -> DataFrame:
    """Pairs by the path of their radiance file."""
    return pairs.orderBy("rad_path")


def pending(pairs: DataFrame, processed: DataFrame) -> DataFrame:
    return pairs.join(processed.select("granule_key"), "granule_key", "left_anti")


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """(granule_key, batch) of a processed log; empty if there is none."""
    try:
        return spark.read.schema("granule_key string, batch string").json(path)
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], "granule_key string, batch string")


def read_processed(spark: SparkSession, path: str) -> DataFrame:
    """(granule_key) of a processed log; empty if there is none."""
    return read_log(spark, path).select("granule_key").distinct()


def log_processed(keys: DataFrame, path: str, batch: str = "") -> None:
    """Append keys; reading takes them as a set, so logging twice changes nothing."""
    keys.select("granule_key", F.lit(batch).alias("batch")).distinct().write.mode("append").json(path)


def calibrated(raw: DataFrame, calibration: DataFrame, bands=None) -> DataFrame:
    """Pixels with a radiance per band from ``raw_<band>`` counts.

    ``calibration``: (granule_key, band, scale, offset, fill, valid_max), joined
    once, pivoted to a row per granule.
    """
    bands = bands or [b for b in K.BANDS if f"raw_{b}" in raw.columns]
    wide = calibration.groupBy("granule_key").agg(
        F.map_from_entries(F.collect_list(F.struct("band", F.struct("scale", "offset", "fill", "valid_max")))).alias("_cal")
    )
    df = raw.join(wide, "granule_key")
    for b in bands:
        c = F.col("_cal")[b]
        df = df.withColumn(b, C.calibrate(F.col(f"raw_{b}"), c["scale"], c["offset"], F.coalesce(c["fill"], F.lit(K.FILL_VALUE)), F.coalesce(c["valid_max"], F.lit(K.VALID_MAX))))
    return df.drop("_cal", *[f"raw_{b}" for b in bands])


def latest(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row per key, the one with the greatest ``order``."""
    w = Window.partitionBy(*keys).orderBy(F.desc(order))
    return df.withColumn("_k", F.row_number().over(w)).filter("_k = 1").drop("_k")
