"""Incremental runs: new granules only, results appended as a batch, then the log.

A run appends its detections under a batch id and then logs (granule, batch).
``read_detections`` takes of each granule the batch that the log names, the
smallest if several do, so rows of a run that crashed before its log entry, or
of a granule that two runs processed, never count.  Nothing written is ever replaced.  Granules without
detections are logged too; granules that could not be read are not, and stay
pending.
"""

from __future__ import annotations

import datetime as dt
import os
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import columns as C
from ..functions import constants as K
from ..functions.shared import checkpoint
from ..plans.detection import detections
from ..sources import granules, netcdf, tables
from ..sources.catalogue import Catalogue


def write_batch(found: DataFrame, path: str, batch: str) -> None:
    """Append detections, partitioned by date and batch: a few files a day, whatever the number of granules."""
    out = found.withColumns({"date": F.to_date("datetime_utc"), "batch": F.lit(batch)})
    out.write.mode("append").partitionBy("date", "batch").parquet(path)


def read_detections(spark: SparkSession, table: str, log: str) -> DataFrame:
    """The detections that count: those of the batch that is logged for their granule."""
    logged = granules.read_log(spark, log).groupBy("granule_key").agg(F.min("batch").alias("batch"))
    try:
        rows = spark.read.option("mergeSchema", True).parquet(table)
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        return spark.createDataFrame([], tables.SCHEMA)
    return rows.join(logged.withColumnRenamed("granule_key", "granule"), ["granule", "batch"], "left_semi").drop("batch", "date")


def failures(pixels: DataFrame) -> DataFrame:
    """(granule_key, error) of the granules that could not be read."""
    if "error" not in pixels.columns:
        return pixels.select(F.col("granule_key").cast("string").alias("granule_key"), F.lit("").alias("error")).limit(0)
    bad = pixels.filter(F.col("error").isNotNull())
    return bad.groupBy(F.col("granule_key").cast("string").alias("granule_key")).agg(F.min("error").alias("error"))


def run_new(pixels: DataFrame, table: str, log: str, box=K.CONUS, progress: Callable[[int, int, str], None] | None = None, **detect) -> DataFrame:
    """Process the granules of ``pixels`` that the log lacks; returns the keys it logged.

    Rows with ``error`` mark granules that could not be read: they are left out
    whole, and the next run tries them again (``failures`` lists them).
    """
    spark = pixels.sparkSession
    done = granules.read_processed(spark, log)
    keyed = pixels.withColumn("_key", F.col("granule_key").cast("string"))
    new = keyed.join(done.select(F.col("granule_key").alias("_key")), "_key", "left_anti")
    if "error" in pixels.columns:
        new = new.join(failures(pixels).select(F.col("granule_key").alias("_key")), "_key", "left_anti").drop("error")
    new = new.drop("_key")
    # written, not cached: appending to the log would refresh a cached plan that reads it
    keys = checkpoint(new.select(F.col("granule_key").cast("string").alias("granule_key")).distinct())
    total = keys.count()
    if progress:
        progress(0, total, "processing")
    if total:
        batch = uuid.uuid4().hex
        write_batch(detections(new, box, **detect), table, batch)
        granules.log_processed(keys, log, batch)
    if progress:
        progress(total, total, "done")
    return keys


def run_pairs(pairs: DataFrame, table: str, log: str, staging: str, box=K.CONUS, progress=None) -> tuple[DataFrame, DataFrame]:
    """(keys processed, failures) of the granule pairs that the log lacks.

    Containers are read once, into a staging table of night pixels inside the
    box, which the passes of the detection then read by column.
    """
    spark = pairs.sparkSession
    todo = checkpoint(granules.pending(pairs, granules.read_processed(spark, log)))
    read = netcdf.read_pixels(todo.repartition(max(1, spark.sparkContext.defaultParallelism), "granule_key"))
    kept = read.filter(region_or_error(box))
    kept.write.mode("overwrite").parquet(staging)
    staged = spark.read.parquet(staging)
    # a granule without a pixel in the region is done as well
    processed = run_new(staged, table, log, box, progress, when=C.key_time(F.col("granule_key")))
    failed = failures(staged)
    bare = checkpoint(todo.select("granule_key").distinct().join(failed, "granule_key", "left_anti").join(processed, "granule_key", "left_anti"))
    if not bare.isEmpty():
        granules.log_processed(bare, log, "none")
    return processed.unionByName(bare), failed


def region_or_error(box):
    return F.col("error").isNotNull() | (C.night(F.col("solar_zenith")) & C.in_box(F.col("latitude"), F.col("longitude"), box))


def fetch_and_process(
    spark: SparkSession, catalogue: Catalogue, start: dt.date, end: dt.date, table: str, log: str, folder: str, bearer: str,
    box=K.CONUS, at_once: int = 16, progress: Callable[[int, int, str], None] | None = None,
) -> dict:
    """Search, download, read, detect, log and delete, ``at_once`` pairs at a time.

    ``folder`` must be one that driver and executors share; the raw files of a
    group go when it is done, whatever came of it.  A pair whose download fails
    stays pending, like one that cannot be read.  Returns the counts found, pending,
    processed and failed, and the failures by granule.
    """
    found = [catalogue.urls(catalogue.search(p, start, end, box)) for p in (granules.RADIANCE, granules.GEOLOCATION)]
    if not all(found):
        return {"found": 0, "pending": 0, "processed": 0, "failed": {}}
    frames = [spark.createDataFrame([(u,) for u in urls], "path string") for urls in found]
    pairs = granules.pair_granules(*frames, unique_left=True)
    todo = [tuple(r) for r in granules.pending(pairs, granules.read_processed(spark, log)).orderBy("granule_key").collect()]  # the catalogue's own answer, already on the driver
    failed: dict[str, str] = {}
    processed = 0
    for at in range(0, len(todo), at_once):
        group = todo[at : at + at_once]
        work = tempfile.mkdtemp(prefix="raw-", dir=folder)
        try:
            if progress:
                progress(at, len(todo), f"downloading {len(group)} pairs")
            local = []
            for key, *urls in group:
                try:
                    local.append((key, *[catalogue.download(u, work, bearer) for u in urls]))
                except OSError as e:
                    failed[key] = f"{type(e).__name__}: {e}"
            if local:
                if progress:
                    progress(at, len(todo), f"processing {len(local)} pairs")
                rows = spark.createDataFrame(local, "granule_key string, rad_path string, geo_path string")
                done, bad = run_pairs(rows, table, log, os.path.join(work, "staging"), box)
                processed += done.count()
                failed |= {r["granule_key"]: r["error"] for r in bad.collect()}  # at most at_once rows
        finally:
            shutil.rmtree(work, ignore_errors=True)
    if progress:
        progress(len(todo), len(todo), "done")
    return {"found": pairs.count(), "pending": len(todo), "processed": processed, "failed": failed}


def follow(spark: SparkSession, folder: str, schema, table: str, log: str, checkpoint_dir: str, box=K.CONUS, **detect) -> StreamingQuery:
    """Structured Streaming over Parquet pixel files as they arrive; stops when all present ones are done.

    Late data is an unseen granule key; a granule's pixels must arrive in one batch.
    """
    stream = spark.readStream.schema(schema).parquet(folder)

    def batch(df: DataFrame, _: int) -> None:
        run_new(df, table, log, box, **detect)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint_dir).trigger(availableNow=True).start()


def hourly_heat(spark: SparkSession, folder: str, schema, delay: str = "1 hour") -> DataFrame:
    """Streaming heat and detections per basin and hour, with late rows up to ``delay``."""
    rows = spark.readStream.schema(schema).parquet(folder).withWatermark("datetime_utc", delay)
    basin = C.backfilled_basin(F.col("basin"), F.col("latitude"), F.col("longitude"))
    return rows.groupBy(F.window("datetime_utc", "1 hour").alias("hour"), basin.alias("basin")).agg(
        F.sum("radiant_heat_MW").alias("sum_rh"), F.count(F.lit(1)).alias("n")
    )
