"""Name -> query and name -> DuckDB SQL for the core analytics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import constants as K
from ..operators import analytics as A
from ..operators import detect as D
from ..operators import fit
from ..sources import granules, tables
from . import detection, oracle, views

RANGES = {"temperature": (600, 2200), "heat": (0.5, 20)}


def _round(df: DataFrame, **digits: int) -> DataFrame:
    return df.select(*[F.round(c, digits[c]).alias(c) if c in digits else F.col(c) for c in df.columns])


def _zone():
    return C.zone(F.col("swath_col"))


def _hot(s, d):
    px = views.pixels(s, d)
    return px, D.hot_pixels(px, D.zonal_stats(px, "M10", _zone()), "M10", _zone())


def zonal_stats(s, d):
    return _round(D.zonal_stats(views.pixels(s, d), "M10", _zone()), mean=8, std=6, threshold=6)


def hot_pixels(s, d):
    return D.row_major(_hot(s, d)[1].select("granule_key", "row", "col", "zone", "M10"))


def local_background(s, d):
    px, hot = _hot(s, d)
    return _round(D.local_background(px, hot), bg_m12=8, sd_m12=6, bg_m13=8)


def background_subtract(s, d):
    px, hot = _hot(s, d)
    df = hot.join(D.local_background(px, hot), ["granule_key", "row", "col"])
    bands = D.usable_radiances(F.col("bg_m12").isNotNull())
    left = lambda b: F.get(F.filter("b", lambda x: x["band"] == b), F.lit(0))["obs"]
    return df.withColumn("b", bands).select(
        "granule_key", "row", "col", F.round(left("M12"), 6).alias("left_M12"), F.round(left("M13"), 6).alias("left_M13"), F.size("b").alias("n_bands")
    )


def calibrate_mask(s, d):
    raw = F.when(F.col("event_id") % 50 == 0, 65535).when(F.col("event_id") % 51 == 0, 65528).otherwise((F.col("event_id") * 131) % 65528)
    return views.events(s, d).select("event_id", raw.cast("int").alias("raw")).select(
        "event_id", F.round(C.calibrate(F.col("raw"), F.lit(0.01), F.lit(-20.0)), 6).alias("radiance")
    )


def _temperatures(s, d):
    return views.events(s, d).select("event_id", F.expr("450.5e0 + (event_id * 7919) % 1900").alias("t"))


def planck_forward(s, d):
    logs = [F.round(F.log10(C.planck_um(K.WAVELENGTHS[b], F.col("t"))), 6).alias(f"log_{b}") for b in K.BANDS]
    return _temperatures(s, d).select("event_id", *logs, F.round(C.wien_peak(F.col("t")) * 1e9, 6).alias("wien_nm"))


def heat(s, d):
    area = C.source_area((1 + F.col("event_id") % 97) * F.lit(1e-6))
    return _temperatures(s, d).select(
        "event_id", F.round(area, 6).alias("area_m2"), F.round(C.radiant_heat(area, F.col("t")), 6).alias("heat_mw")
    )


def _sources(s, d):
    return views.events(s, d).selectExpr("event_id", "600e0 + (event_id * 37) % 1500 as t", "(1 + event_id % 9) * 1e-6 as esf").select(
        "event_id",
        *[
            (F.col("esf") * C.planck_um(K.WAVELENGTHS[b], F.col("t")) * (1 + 0.01 * ((F.col("event_id") * (k + 3)) % 7 - 3))).alias(b)
            for k, b in enumerate(oracle.SOURCE_BANDS)
        ],
    )


def planck_fit_grid(s, d):
    best = fit.spread(_sources(s, d)).select("event_id", fit.grid_fit({b: F.col(b) for b in oracle.SOURCE_BANDS}).alias("g"))
    return best.select("event_id", F.col("g.t").cast("int").alias("temperature_K"), F.round(F.log10("g.esf"), 6).alias("log_esf"))


def planck_fit(s, d):
    bands = F.array(*[F.struct(F.lit(b).alias("band"), F.lit(K.WAVELENGTHS[b]).alias("w"), F.col(b).alias("obs")) for b in oracle.SOURCE_BANDS])
    return fit.spread(_sources(s, d)).select("event_id", fit.planck_fit(bands).alias("f")).select("event_id", "f.*")


def detections(s, d):
    return detection.detections(views.pixels(s, d), K.CONUS, _zone(), F.col("ts").cast("timestamp"))


def detections_grid(s, d):
    return _round(detection.grid_detections(views.pixels(s, d), K.CONUS, _zone()), log_esf=6)


def region_counts(s, d):
    return detection.roi_counts(views.pixels(s, d))


def granule_counts(s, d):
    return detection.granule_counts(views.pixels(s, d), K.CONUS, _zone())


def calibrated_scan(s, d):
    """Radiances of two bands from counts, each with its granule's and band's own calibration."""
    e = F.col("event_id")
    raw = views.pixels(s, d).withColumn("event_id", F.col("granule_key") * 1600 + F.col("row") * 40 + F.col("col")).select(
        "granule_key", "row", "col",
        F.when(e % 50 == 0, 65535).when(e % 51 == 0, 65530).otherwise((e * 131) % 65528).cast("int").alias("raw_M10"),
        F.when(e % 49 == 0, 60000).otherwise((e * 37) % 65000).cast("int").alias("raw_M11"),
    )
    keys = raw.select("granule_key").distinct()
    g = F.col("granule_key")
    cal = keys.select(
        "granule_key", F.lit("M10").alias("band"), ((g % 7 + 1) * 0.01).alias("scale"), (-20.0 - g % 3).alias("offset"), F.lit(None).cast("int").alias("fill"), F.lit(None).cast("int").alias("valid_max")
    ).unionByName(
        keys.select("granule_key", F.lit("M11").alias("band"), ((g % 5 + 1) * 0.002).alias("scale"), F.lit(-1.0).alias("offset"), F.lit(60000).alias("fill"), F.lit(64000).alias("valid_max"))
    )
    return _round(granules.calibrated(raw, cal), M10=6, M11=6)


def site_keys(s, d):
    """Sites as text, with the hour of each detection."""
    return views.detections(s, d).select(*KEY, "hour_utc", C.site_text(F.col("latitude"), F.col("longitude")).alias("site"))


def _files(s, d):
    e = F.col("event_id")
    half = F.expr("event_id div 2")
    pad = lambda c, n: F.lpad(c.cast("string"), n, "0")
    name = F.when(e % 11 == 0, F.concat(F.lit("odd"), e.cast("string"))).otherwise(
        F.concat(F.lit("VJ10"), (2 + e % 2).cast("string"), F.lit("MOD.A2024"), pad(1 + half % 366, 3), F.lit("."), pad(half % 24, 2), pad((half % 10) * 6, 2), F.lit(".021.nc"))
    )
    return views.events(s, d).select("event_id", F.concat(F.lit("data/"), (e % 3).cast("string"), F.lit("/"), name).alias("path"))


def parse_filename(s, d):
    name = C.base_name(F.col("path"))
    return _files(s, d).select("event_id", C.granule_key(name).alias("granule_key"), C.acquired(name).alias("datetime_utc"))


def granule_pairs(s, d):
    files = _files(s, d).withColumn("product", F.substring_index(C.base_name(F.col("path")), ".", 1))
    return granules.ordered_pairs(granules.pair_granules(files.filter(F.col("product") == granules.RADIANCE), files.filter(F.col("product") == granules.GEOLOCATION)))


def pending_pairs(s, d):
    done = _files(s, d).filter("event_id % 5 = 0").select(C.granule_key(C.base_name(F.col("path"))).alias("granule_key")).filter("granule_key is not null")
    return granules.pending(granule_pairs(s, d), done)


KEY = ["granule", "row", "col"]


def _filtered(s, d):
    return A.select_detections(views.detections(s, d), **RANGES)


def filters(s, d):
    df = A.select_detections(
        views.detections(s, d), dates=("2024-01-05", "2024-01-20"), classes=("gas_flare", "smoldering"), temperature=(500, 2000),
        heat=(0.5, 20), basins=("Permian", "Bakken", "Other"),
    )
    return df.select(*KEY, "date", "temperature_K", "radiant_heat_MW")


def site_persistence(s, d):
    return A.with_persistence(_filtered(s, d)).select(*KEY, "days_seen", "persistence")


def persistence_filter(s, d):
    df = A.persistence_between(A.with_persistence(_filtered(s, d)), 5, 50)
    return df.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("site_lat_i", "site_lon_i").alias("n_sites"))


def kpis(s, d):
    base = _filtered(s, d)
    kept = A.persistence_between(A.with_persistence(base), 5, 100)
    return _round(A.kpis(kept, A.nights(base)), sum_rh=4, mean_t=4, avg_mmscfd=2)


def volume_summary(s, d):
    base = _filtered(s, d)
    kept = A.persistence_between(A.with_persistence(base), 5, 100)
    return _round(A.volume_summary(kept, A.nights(base)), total_bcm=4, avg_mmscfd=2, peak_mmscfd=2, annual_bscf=2)


def _volume(by=None):
    return lambda s, d: _round(A.volume(_filtered(s, d), by), sum_rh=4, mmscfd=2)


def top_flares(s, d):
    return _round(A.top_by_heat(views.detections(s, d), 25), source_area_m2=4)


def calendar_spine(s, d):
    rows = A.filled_calendar(views.detections(s, d))
    return rows.groupBy("date", "placeholder").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.coalesce(F.sum("radiant_heat_MW"), F.lit(0.0)), 4).alias("sum_rh")
    )


def append_align(s, d):
    det = views.detections(s, d)
    old = det.filter("col % 2 = 0").select(*KEY, "temperature_K")
    new = det.filter("col % 2 = 1").select(*KEY, (F.col("radiant_heat_MW") > 5).cast("string").alias("detected_M12"))
    return tables.append_aligned(old, new)


def _dated(query):
    """Dates as text, so that engines agree on their form."""
    return lambda s, d: query(s, d).withColumn("date", F.col("date").cast("string"))


DATED = ("filters", "daily", "daily_ts", "volume_daily", "volume_basin", "volume_class", "calendar_spine", "map_frames")


def queries() -> dict:
    return {name: _dated(q) if name in DATED else q for name, q in _queries().items()}


def _queries() -> dict:
    det = views.detections
    return {
        "zonal_stats": zonal_stats,
        "hot_pixels": hot_pixels,
        "local_background": local_background,
        "region_counts": region_counts,
        "background_subtract": background_subtract,
        "calibrate_mask": calibrate_mask,
        "planck_forward": planck_forward,
        "heat": heat,
        "classify_source": lambda s, d: det(s, d).select(*KEY, "temperature_K", "classification"),
        "classify_basin": lambda s, d: det(s, d).select(*KEY, "basin"),
        "backfill_basin": lambda s, d: det(s, d).select(
            *KEY, C.backfilled_basin(F.when(F.col("col") % 3 == 0, "kept"), F.col("latitude"), F.col("longitude")).alias("basin")
        ),
        "site_grid": lambda s, d: det(s, d).select(*KEY, "site_lat_i", "site_lon_i"),
        "planck_fit_grid": planck_fit_grid,
        "planck_fit": planck_fit,
        "detections": detections,
        "detections_grid": detections_grid,
        "granule_counts": granule_counts,
        "calibrated_scan": calibrated_scan,
        "site_keys": site_keys,
        "parse_filename": parse_filename,
        "granule_pairs": granule_pairs,
        "pending_pairs": pending_pairs,
        "filters": filters,
        "dashboard_defaults": lambda s, d: A.default_ranges(det(s, d)),
        "site_persistence": site_persistence,
        "persistence_filter": persistence_filter,
        "kpis": kpis,
        "daily": lambda s, d: A.daily_summary(det(s, d)),
        "basin_summary": lambda s, d: A.basin_summary(det(s, d)),
        "class_counts": lambda s, d: A.class_counts(det(s, d)),
        "daily_ts": lambda s, d: _round(A.daily_series(det(s, d)), sum_rh=4, mean_t=4),
        "volume_daily": _volume(),
        "volume_basin": _volume("basin"),
        "volume_class": _volume("classification"),
        "volume_summary": volume_summary,
        "rh_p98": lambda s, d: _round(A.heat_p98(det(s, d)), p98=6),
        "extent_view": lambda s, d: _round(A.extent(det(s, d)), mean_latitude=6, mean_longitude=6, pad_lat=6, pad_lon=6),
        "hist_temp": lambda s, d: A.histogram(det(s, d), "temperature_K", split="classification"),
        "hist_rh": lambda s, d: A.histogram(det(s, d), "radiant_heat_MW", split="basin", below=5),
        "hist_area": lambda s, d: A.histogram(det(s, d), "source_area_m2", below=10),
        "options": lambda s, d: A.options(det(s, d), "basin"),
        "distinct_granules": lambda s, d: A.distinct_granules(det(s, d)),
        "flare_ranges": lambda s, d: A.flare_ranges(det(s, d)),
        "top_flares": top_flares,
        "calendar_spine": calendar_spine,
        "map_points": lambda s, d: _round(A.map_points(det(s, d)), size_px=6),
        "map_extent": lambda s, d: A.map_extent(det(s, d)),
        "map_frames": lambda s, d: _round(A.frames(det(s, d)), size_px=6),
        "kml_rows": lambda s, d: tables.kml_rows(det(s, d)),
        "append_align": append_align,
    }


def oracle_sql() -> dict:
    return oracle.sql()
