"""Outlier detection on pixel tables.

A pixel table has granule_key, row, col, latitude, longitude, solar_zenith and a
DOUBLE column per band, NULL where masked.  All granules of a table go through
one plan; the granule is a grouping column.
"""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import constants as K
from ..functions import shared
from ..functions.shared import checkpoint, small_side


def region(pixels: DataFrame, box=K.CONUS) -> DataFrame:
    """Night pixels inside the box."""
    return pixels.filter(C.night(F.col("solar_zenith")) & C.in_box(F.col("latitude"), F.col("longitude"), box))


def _clipped(rows: DataFrame, bands) -> DataFrame:
    """Clipping by windows over (granule, zone): one scan and one shuffle, however many granules."""
    w = Window.partitionBy("granule_key", "zone")
    for _ in range(K.CLIP_ROUNDS):
        for b in bands:
            m, s = F.avg(b).over(w), F.stddev_pop(b).over(w)
            rows = rows.withColumn(b, F.when((s == 0) | (F.col(b) < m + K.CLIP_SIGMA * s), F.col(b)))
    return rows.groupBy("granule_key", "zone").agg(*_moments(bands, {b: F.col(b) for b in bands}))


def _moments(bands, values) -> list[Column]:
    return [f(values[b]).alias(f"{n}_{b}") for b in bands for n, f in (("mean", F.avg), ("std", F.stddev_pop), ("n", F.count))]


def clip_stats(pixels: DataFrame, bands=("M10",), zone: Column | None = None) -> DataFrame:
    """(granule_key, zone, mean_<band>, std_<band>, n_<band>) after upper sigma clipping.

    Clipping is one-sided, so what is left after k rounds are the values below
    the least cutoff so far: the state is one row per granule and zone.  Each
    round is a partially aggregated pass over the region's pixels for all bands at
    once; its rows, at most ``BROADCAST_ROWS``, are broadcast to the next, so no
    pixel is shuffled, and rounds end when no zone loses a value.  Where there are
    more, windows do it with one shuffle instead.
    """
    zone = C.zone(F.col("col")) if zone is None else zone
    positive = [F.when(F.col(b) > 0, F.col(b)).alias(b) for b in bands]
    rows = pixels.select("granule_key", zone.alias("zone"), *positive).filter(
        F.col("zone").isNotNull() & F.coalesce(*[F.col(b) for b in bands]).isNotNull()
    )
    key = ["granule_key", "zone"]
    found = _few(rows.groupBy(*key).agg(*_moments(bands, {b: F.col(b) for b in bands})))
    if found is None:
        return _clipped(rows, bands)
    stats = pixels.sparkSession.createDataFrame(found)
    for k in range(K.CLIP_ROUNDS):
        cuts = []
        for b in bands:
            limit = F.when(F.col(f"std_{b}") > 0, F.col(f"mean_{b}") + K.CLIP_SIGMA * F.col(f"std_{b}"))
            cuts += [(F.least(limit, F.col(f"cut_{b}")) if k else limit).alias(f"cut_{b}"), F.col(f"n_{b}").alias(f"was_{b}")]
        joined = rows.join(F.broadcast(stats.select(*key, *cuts)), key)
        kept = {b: F.when(F.col(f"cut_{b}").isNull() | (F.col(b) < F.col(f"cut_{b}")), F.col(b)) for b in bands}
        before = [F.first(f"{n}_{b}").alias(f"{n}_{b}") for b in bands for n in ("cut", "was")]
        found = _few(joined.groupBy(*key).agg(*_moments(bands, kept), *before))
        stats = pixels.sparkSession.createDataFrame(found)
        if not any(pc.any(pc.less(found[f"n_{b}"], found[f"was_{b}"])).as_py() for b in bands):
            break
    return stats.select(*key, *[f"{n}_{b}" for b in bands for n in ("mean", "std", "n")])


def _few(stats: DataFrame) -> pa.Table | None:
    """The rows on the driver, from one job; None if there are more than may be broadcast."""
    rows = stats.limit(shared.BROADCAST_ROWS + 1).toArrow()
    return rows if rows.num_rows <= shared.BROADCAST_ROWS else None


def band_stats(stats: DataFrame, band: str) -> DataFrame:
    """(granule_key, zone, mean, std, threshold, n_pixels) of one band of ``clip_stats``."""
    mean, std, n = (F.col(f"{x}_{band}") for x in ("mean", "std", "n"))
    return stats.filter(n > 0).select(
        "granule_key", "zone", mean.alias("mean"), std.alias("std"), (mean + K.HOT_SIGMA * std).alias("threshold"), n.alias("n_pixels")
    )


def zonal_stats(pixels: DataFrame, band: str = "M10", zone: Column | None = None) -> DataFrame:
    """(granule_key, zone, mean, std, threshold, n_pixels) of one band."""
    return band_stats(clip_stats(pixels, (band,), zone), band)


def hot_pixels(pixels: DataFrame, stats: DataFrame, band: str = "M10", zone: Column | None = None) -> DataFrame:
    """Rows of ``pixels`` above their zone's threshold, strictly."""
    zone = C.zone(F.col("col")) if zone is None else zone
    limits = small_side(stats.select("granule_key", "zone", "threshold"))
    return pixels.withColumn("zone", zone).join(limits, ["granule_key", "zone"]).filter(F.col(band) > F.col("threshold"))


def row_major(found: DataFrame) -> DataFrame:
    """By granule, scan line and sample."""
    return found.orderBy("granule_key", "row", "col")


def local_background(pixels: DataFrame, hot: DataFrame, half: int = K.HALF_WINDOW, written: bool = False) -> DataFrame:
    """(granule_key, row, col, n_bg, bg_m12, sd_m12, bg_m13, detected_M12) of every hot pixel.

    The square window is an equi-join: each hot pixel, materialised once (unless ``written`` says it is), is spread over the offsets
    of its window and meets the pixels by position; hot pixels are no background.
    """
    key = ["granule_key", "row", "col"]
    own = hot.select(*key, F.col("M12").alias("own"))
    own = own if written else checkpoint(own)
    n = own.count()
    spots = own.select(*key).distinct()
    offsets = F.explode(F.sequence(F.lit(-half), F.lit(half)))
    cells = spots.select("granule_key", "row", "col", offsets.alias("dr")).select(
        "granule_key", "row", "col", "dr", offsets.alias("dc")
    ).select("granule_key", F.col("row").alias("hot_row"), F.col("col").alias("hot_col"), (F.col("row") + F.col("dr")).alias("row"), (F.col("col") + F.col("dc")).alias("col"))
    around = pixels.select(*key, "M12", "M13").filter("M12 is not null and M13 is not null")
    around = around.join(small_side(cells, n * (2 * half + 1) ** 2), key).join(small_side(spots, n), key, "left_anti")
    stats = around.groupBy("granule_key", "hot_row", "hot_col").agg(
        F.count(F.lit(1)).alias("n_bg"), F.avg("M12").alias("m12"), F.stddev_pop("M12").alias("s12"), F.avg("M13").alias("m13")
    ).filter(F.col("n_bg") >= K.LEAST_BACKGROUND)
    return own.join(
        stats.withColumnsRenamed({"hot_row": "row", "hot_col": "col"}), key, "left"
    ).select(
        *key, F.coalesce("n_bg", F.lit(0)).alias("n_bg"), F.col("m12").alias("bg_m12"),
        F.col("s12").alias("sd_m12"), F.col("m13").alias("bg_m13"),
        F.coalesce(F.col("own") > F.col("m12") + K.LOCAL_SIGMA * F.col("s12"), F.lit(False)).alias("detected_M12"),
    )


def usable_radiances(has_background: Column) -> Column:
    """array<struct<band, w, obs>> for the fit: positive short-wave bands, and mid-wave
    bands less their background where that is known and leaves something."""
    entries = []
    for b in K.SWIR_BANDS:
        entries.append(F.when(F.col(b) > 0, F.struct(F.lit(b).alias("band"), F.lit(K.WAVELENGTHS[b]).alias("w"), F.col(b).alias("obs"))))
    for b in K.MWIR_BANDS:
        left = F.col(b) - F.col(f"bg_{b.lower()}")
        entries.append(
            F.when(
                has_background & (F.col(b) > 0) & (left > 0),
                F.struct(F.lit(b).alias("band"), F.lit(K.WAVELENGTHS[b]).alias("w"), left.alias("obs")),
            )
        )
    return F.filter(F.array(*entries), lambda x: x.isNotNull())
