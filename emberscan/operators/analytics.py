"""Queries over the detection table: filters, persistence, summaries, figures' data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import constants as K

T, RH, AREA = "temperature_K", "radiant_heat_MW", "source_area_m2"


def enrich(detections: DataFrame) -> DataFrame:
    """date, hour_utc, site grid and a basin where it was missing."""
    return detections.withColumns(
        {
            "date": F.to_date("datetime_utc"),
            "hour_utc": F.hour("datetime_utc"),
            "basin": C.backfilled_basin(F.col("basin"), F.col("latitude"), F.col("longitude")),
            "site_lat_i": C.grid(F.col("latitude")).cast("long"),
            "site_lon_i": C.grid(F.col("longitude")).cast("long"),
        }
    )


def select_detections(
    df: DataFrame, dates=None, classes=None, temperature=None, heat=None, basins=None
) -> DataFrame:
    """Conjunctive filters; ranges are inclusive, None means no filter, NULLs never pass a range."""
    if dates:
        df = df.filter(F.col("date").between(F.lit(dates[0]).cast("date"), F.lit(dates[1]).cast("date")))
    if classes is not None:
        df = df.filter(F.col("classification").isin(list(classes)))
    if temperature:
        df = df.filter(F.col(T).between(*temperature))
    if heat:
        df = df.filter(F.col(RH).between(*heat))
    if basins is not None:
        df = df.filter(F.col("basin").isin(list(basins)))
    return df


def default_ranges(df: DataFrame) -> DataFrame:
    """(t_min, t_max, rh_min, rh_max): whole-degree bounds, and heat capped at 20 MW."""
    return df.agg(
        F.min(T).cast("int").alias("t_min"), F.max(T).cast("int").alias("t_max"),
        F.min(RH).alias("rh_min"), F.least(F.max(RH), F.lit(20.0)).alias("rh_max"),
    )


def nights(df: DataFrame) -> DataFrame:
    return df.agg(F.countDistinct("date").alias("n_nights"))


def with_persistence(df: DataFrame) -> DataFrame:
    """days_seen and persistence beside every detection.

    Days per site come from a distinct aggregate (partial before the shuffle) and
    a left equi-join on the two grid integers, in which detections without
    coordinates are one site; the number of nights is one row.
    """
    days = df.groupBy(F.col("site_lat_i").alias("_lat"), F.col("site_lon_i").alias("_lon")).agg(F.countDistinct("date").alias("days_seen"))
    same = F.col("site_lat_i").eqNullSafe(F.col("_lat")) & F.col("site_lon_i").eqNullSafe(F.col("_lon"))
    joined = df.join(days, same, "left").drop("_lat", "_lon")
    return joined.join(F.broadcast(nights(df))).withColumn(  # one row
        "persistence", C.persistence(F.col("days_seen"), F.col("n_nights"))
    )


def persistence_between(df: DataFrame, low: float, high: float) -> DataFrame:
    return df.filter(F.col("persistence").between(low, high))


def _flares() -> Column:
    return F.count_if(F.col("classification") == "gas_flare")


def kpis(df: DataFrame, n_nights: DataFrame) -> DataFrame:
    """Headline numbers of ``df``; nights are counted on the rows before the persistence filter."""
    sums = df.agg(
        F.count(F.lit(1)).alias("n_detections"), _flares().alias("n_flares"), F.sum(RH).alias("sum_rh"), F.avg(T).alias("mean_t")
    )
    return sums.join(F.broadcast(n_nights)).select(
        "n_detections", "n_flares", "sum_rh", "mean_t",
        (C.mmscfd(F.col("sum_rh")) / F.greatest("n_nights", F.lit(1))).alias("avg_mmscfd"),
    )


def daily_summary(df: DataFrame) -> DataFrame:
    return df.groupBy("date").agg(
        F.count(T).alias("detections"), _flares().alias("flares"),
        C.half_even(F.sum(RH)).alias("total_rh"), C.half_even(F.avg(T)).alias("mean_t"),
    )


def basin_summary(df: DataFrame) -> DataFrame:
    return df.groupBy("basin").agg(
        F.count(T).alias("detections"), C.half_even(F.sum(RH)).alias("total_rh"), C.half_even(F.avg(T)).alias("mean_t")
    ).orderBy(F.desc_nulls_last("total_rh"), "basin")


def class_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("classification").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "classification")


def daily_series(df: DataFrame) -> DataFrame:
    return df.groupBy("date").agg(F.sum(RH).alias("sum_rh"), _flares().alias("flares"), F.avg(T).alias("mean_t"))


def volume(df: DataFrame, by: str | None = None) -> DataFrame:
    """Daily flared volume, whole or split by ``by``."""
    return df.groupBy("date", *([by] if by else [])).agg(F.sum(RH).alias("sum_rh")).withColumn("mmscfd", C.mmscfd(F.col("sum_rh")))


def volume_summary(df: DataFrame, n_nights: DataFrame) -> DataFrame:
    """Average, peak and yearly rate; the yearly one only with more than one night."""
    daily = df.groupBy("date").agg(F.sum(RH).alias("rh"))
    whole = daily.agg(F.coalesce(F.sum("rh"), F.lit(0.0)).alias("rh"), F.coalesce(F.max("rh"), F.lit(0.0)).alias("peak"))
    avg = C.mmscfd(F.col("rh")) / F.greatest("n_nights", F.lit(1))
    return whole.join(F.broadcast(n_nights)).select(
        C.bcm(F.col("rh")).alias("total_bcm"), avg.alias("avg_mmscfd"), C.mmscfd(F.col("peak")).alias("peak_mmscfd"),
        F.when(F.col("n_nights") > 1, avg * 365 / 1000).alias("annual_bscf"),
    )


#: Values that one task sorts for an exact quantile.
SORTED_VALUES = 100_000


def exact_quantile(df: DataFrame, column: str, q: float) -> float | None:
    """The interpolated quantile of a column's values, NULLs aside; None without any.

    Approximate quantiles bracket the two ranks, counts say how many values lie
    below, and the bracket narrows until one task can sort what is in it; a value
    that many rows share is counted, not listed.
    """
    values = df.select(F.col(column).cast("double").alias("v")).filter("v is not null")
    n, low, high = values.agg(F.count("v"), F.min("v"), F.max("v")).first()
    if not n:
        return None
    ranks = (int(q * (n - 1)), min(int(q * (n - 1)) + 1, n - 1))
    below, inside = 0, n
    while inside > SORTED_VALUES and low < high:
        part = values.filter(F.col("v").between(low, high))
        near = [(r - below) / max(inside - 1, 1) for r in ranks]
        a, b = part.agg(F.percentile_approx("v", [max(near[0] - 0.002, 0.0), min(near[1] + 0.002, 1.0)], 10_000)).first()[0]
        c = part.agg(F.count_if(F.col("v") < a), F.count_if(F.col("v").between(a, b))).first()
        fits = below + c[0] <= ranks[0] and ranks[1] < below + c[0] + c[1]
        if not fits or c[1] == inside:
            break
        low, high, below, inside = a, b, below + c[0], c[1]
    counts = values.filter(F.col("v").between(low, high)).groupBy("v").agg(F.count(F.lit(1)).alias("c"))
    order = Window.orderBy("v")
    upto = counts.withColumn("upto", F.sum("c").over(order) + below)
    found = [upto.filter(F.col("upto") > r).agg(F.min("v")).first()[0] for r in ranks]
    share = q * (n - 1) - ranks[0]
    return found[0] + share * (found[1] - found[0])


def heat_p98(df: DataFrame) -> DataFrame:
    """Exact interpolated 98th percentile of heat, at least 1."""
    p98 = exact_quantile(df, RH, 0.98)
    return df.sparkSession.range(1).select(F.lit(max(1.0, p98 if p98 is not None else 1.0)).alias("p98"))


def extent(df: DataFrame) -> DataFrame:
    """Map view: centre, span, zoom, padding."""
    e = df.agg(
        *[f(c).alias(f"{n}_{c}") for c in ("latitude", "longitude") for n, f in (("min", F.min), ("max", F.max), ("mean", F.avg))]
    )
    span = F.greatest(F.col("max_latitude") - F.col("min_latitude"), F.col("max_longitude") - F.col("min_longitude"))
    return e.withColumn("zoom", C.zoom(span)).withColumn("pad_lat", C.padding(F.col("max_latitude") - F.col("min_latitude"))).withColumn(
        "pad_lon", C.padding(F.col("max_longitude") - F.col("min_longitude"))
    )


def histogram(
    df: DataFrame, column: str, low: float | None = None, high: float | None = None, bins: int = 40, split: str | None = None, below: float | None = None
) -> DataFrame:
    """Equal-width bins over [low, high], by default from the least to the greatest value; the last one holds ``high``.

    ``below`` keeps smaller values only, before the extent is taken.  If all values are equal they are in bin 0.
    """
    if below is not None:
        df = df.filter(F.col(column) < below)
    ends = df.agg(
        (F.min(column) if low is None else F.first(F.lit(float(low)))).alias("_low"), (F.max(column) if high is None else F.first(F.lit(float(high)))).alias("_high")
    )
    rows = df.join(F.broadcast(ends)).filter(F.col(column).between(F.col("_low"), F.col("_high")))  # one row
    width = (F.col("_high") - F.col("_low")) / bins
    b = F.when(width > 0, F.least(F.floor((F.col(column) - F.col("_low")) / width), F.lit(bins - 1))).otherwise(0).cast("int")
    return rows.groupBy(b.alias("bin"), *([split] if split else [])).agg(F.count(F.lit(1)).alias("n"))


def options(df: DataFrame, column: str) -> DataFrame:
    return df.filter(F.col(column).isNotNull()).select(column).distinct().orderBy(column)


def distinct_granules(df: DataFrame) -> DataFrame:
    return df.agg(F.countDistinct("granule").alias("n_granules"))


def flare_ranges(df: DataFrame) -> DataFrame:
    flares = df.filter(F.col("classification") == "gas_flare")
    return flares.agg(
        F.count(F.lit(1)).alias("n_flares"), F.min(T).alias("t_min"), F.max(T).alias("t_max"), F.min(RH).alias("rh_min"), F.max(RH).alias("rh_max")
    )


def top_by_heat(df: DataFrame, n: int = 25) -> DataFrame:
    """The n hottest by heat, ranked from 1, with a total order for ties; NULL heat last."""
    order = [F.desc_nulls_last(RH), F.asc("datetime_utc"), F.asc("granule"), F.asc("row"), F.asc("col")]
    top = df.orderBy(*order).limit(n)
    # the window sees n rows at most
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order))).select(
        "rank", "datetime_utc", "latitude", "longitude", "basin", "classification", T, RH, AREA, "granule", "row", "col"
    )


def calendar(df: DataFrame) -> DataFrame:
    """Every date between first and last."""
    ends = df.agg(F.min("date").alias("a"), F.max("date").alias("b"))
    return ends.filter("a is not null").select(F.explode(F.sequence("a", "b")).alias("date"))


def filled_calendar(df: DataFrame) -> DataFrame:
    """Daily rows of ``df`` with a placeholder (heat 0, no class) for each date without one."""
    have = df.select("date", F.lit(False).alias("placeholder"), "classification", "basin", T, RH)
    missing = calendar(df).join(df.select("date").distinct(), "date", "left_anti").select(
        "date", F.lit(True).alias("placeholder"), F.lit("").alias("classification"), F.lit("").alias("basin"),
        F.lit(None).cast("double").alias(T), F.lit(0.0).alias(RH),
    )
    return have.unionByName(missing)


def map_points(df: DataFrame) -> DataFrame:
    """Fitted detections with marker sizes, failed ones without."""
    return df.select(
        "latitude", "longitude", F.col(T).isNotNull().alias("fitted"), T,
        F.when(F.col(T).isNotNull(), C.map_marker(F.col(RH))).alias("size_px"),
    )


def map_extent(df: DataFrame, box=None) -> DataFrame:
    """(south, north, west, east) of a static map: the box, or the detections' bounds and half a degree around."""
    if box is not None:
        return df.sparkSession.range(1).select(*[F.lit(float(v)).alias(n) for v, n in zip(box, ("south", "north", "west", "east"))])
    return df.agg(
        (F.min("latitude") - 0.5).alias("south"), (F.max("latitude") + 0.5).alias("north"),
        (F.min("longitude") - 0.5).alias("west"), (F.max("longitude") + 0.5).alias("east"),
    )


def frames(df: DataFrame) -> DataFrame:
    """Animation data: detections with heat, sized against the 98th percentile, a row per empty date."""
    lit = df.filter(F.col(RH) > 0)
    sized = lit.join(F.broadcast(heat_p98(lit))).select("date", "latitude", "longitude", C.frame_marker(F.col(RH), F.col("p98")).alias("size_px"))
    return calendar(df).join(sized, "date", "left").orderBy("date")
