"""From pixels to detections: one lazy plan for all granules of a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import constants as K
from ..functions.shared import checkpoint
from ..operators import detect, fit


def candidates(pixels: DataFrame, box=K.CONUS, zone: Column | None = None) -> DataFrame:
    """Hot M10 pixels with confirmation flags, local background and the radiances to fit.

    Pixels are scanned four times at most for the statistics of both bands, once for
    the hot ones and once for their surroundings; all else works on hot pixels.
    """
    roi = detect.region(pixels, box)
    stats = detect.clip_stats(roi, ("M10", "M11"), zone)
    hot = checkpoint(detect.hot_pixels(roi, detect.band_stats(stats, "M10"), "M10", zone).drop("threshold"))
    confirm = detect.band_stats(stats, "M11").select("granule_key", "zone", F.col("threshold").alias("m11_limit"))
    back = detect.local_background(roi, hot, written=True)
    out = hot.join(confirm, ["granule_key", "zone"], "left").join(back, ["granule_key", "row", "col"])
    out = out.withColumn("detected_M11", F.coalesce(F.col("M11") > F.col("m11_limit"), F.lit(False)))
    return out.withColumn("fit_bands", detect.usable_radiances(F.col("bg_m12").isNotNull())).drop("m11_limit", "zone")


def detections(pixels: DataFrame, box=K.CONUS, zone: Column | None = None, when: Column | None = None) -> DataFrame:
    """The detection table of a pixel table."""
    fitted = fit.with_fit(candidates(pixels, box, zone))
    return fitted.select(
        (F.lit(None).cast("timestamp") if when is None else when).alias("datetime_utc"),
        "latitude", "longitude", C.basin(F.col("latitude"), F.col("longitude")).alias("basin"), "row", "col",
        F.col("granule_key").cast("string").alias("granule"),
        *[F.col(b).alias(f"radiance_{b}") for b in K.BANDS],
        "temperature_K", "esf", "source_area_m2", "radiant_heat_MW", "fit_cost", "classification", "n_bands_used", "detected_M11", "detected_M12",
    )


def roi_counts(pixels: DataFrame, box=K.CONUS) -> DataFrame:
    return pixels.groupBy("granule_key").agg(
        F.count(F.lit(1)).alias("n_pixels"),
        F.count_if(C.night(F.col("solar_zenith")) & C.in_box(F.col("latitude"), F.col("longitude"), box)).alias("n_region"),
    )


def granule_counts(pixels: DataFrame, box=K.CONUS, zone: Column | None = None) -> DataFrame:
    """(granule_key, n_pixels, n_region, n_hot) of every granule."""
    roi = detect.region(pixels, box)
    hot = detect.hot_pixels(roi, detect.zonal_stats(roi, "M10", zone), "M10", zone).groupBy("granule_key").agg(F.count(F.lit(1)).alias("n_hot"))
    return roi_counts(pixels, box).join(hot, "granule_key", "left").withColumn("n_hot", F.coalesce("n_hot", F.lit(0)))


def grid_detections(pixels: DataFrame, box=K.CONUS, zone: Column | None = None) -> DataFrame:
    """Detections with the fit's grid alone: all of it stays in the JVM and SQL can repeat it."""
    found = candidates(pixels, box, zone)
    bands = [*K.SWIR_BANDS, *K.MWIR_BANDS]

    def only(b: str) -> Column:
        return F.get(F.filter("fit_bands", lambda x: x["band"] == b), F.lit(0))["obs"]

    obs = {b: only(b) for b in bands}
    found = found.select("granule_key", "row", "col", "latitude", "longitude", "detected_M11", "detected_M12", *[v.alias(f"o_{b}") for b, v in obs.items()])
    fits = fit.can_fit({b: F.col(f"o_{b}") for b in bands})
    found = found.withColumn("g", F.when(fits, fit.grid_fit({b: F.col(f"o_{b}") for b in bands})))
    t = F.col("g.t")
    return found.select(
        "granule_key", "row", "col", C.basin(F.col("latitude"), F.col("longitude")).alias("basin"), t.cast("int").alias("temperature_K"),
        F.log10("g.esf").alias("log_esf"), C.source_class(t).alias("classification"), "detected_M11", "detected_M12",
        F.when(fits, sum((F.col(f"o_{b}").isNotNull().cast("int") for b in bands[1:]), F.col(f"o_{bands[0]}").isNotNull().cast("int"))).otherwise(0).alias("n_bands_used"),
    )
