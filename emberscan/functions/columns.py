"""Column builders: every scalar rule as a Catalyst expression."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as K


def clean(c: Column) -> Column:
    """NaN and infinities to NULL, so that comparisons drop and aggregates skip them."""
    c = c.cast("double")
    return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)


def first_present(columns: list[str], candidates: list[str]) -> Column:
    """First of ``candidates`` that a table has; KeyError if none."""
    for name in candidates:
        if name in columns:
            return F.col(f"`{name}`")
    raise KeyError(f"none of {candidates} is present")


def zone(col: Column, zones=K.ZONES) -> Column:
    """Zone number of a swath column; NULL outside all; one zone 0 if ``zones`` is None."""
    if zones is None:
        return F.lit(0)
    return reduce(lambda acc, z: acc.when((col >= z[1][0]) & (col < z[1][1]), F.lit(z[0])), enumerate(zones), F).cast("int")


def calibrate(raw: Column, scale: Column, offset: Column, fill: Column | None = None, valid_max: Column | None = None) -> Column:
    """Counts to radiance; fill, invalid and non-positive values are NULL."""
    fill = F.lit(K.FILL_VALUE) if fill is None else fill
    valid_max = F.lit(K.VALID_MAX) if valid_max is None else valid_max
    value = raw.cast("double") * scale + offset
    return F.when((raw < valid_max + 1) & (raw != fill) & (value > 0), value)


def night(sza: Column) -> Column:
    return sza > K.NIGHT_ZENITH


def in_box(lat: Column, lon: Column, box=K.CONUS) -> Column:
    return lat.between(box[0], box[1]) & lon.between(box[2], box[3])


def planck_m(wavelength: Column | float, t: Column) -> Column:
    """Spectral radiance per metre; the exponent is held within 0..500."""
    w = wavelength if isinstance(wavelength, Column) else F.lit(float(wavelength))
    x = F.lit(K.PLANCK_H * K.LIGHT_C) / (w * F.lit(K.BOLTZMANN_K) * t)
    x = F.least(F.greatest(x, F.lit(0.0)), F.lit(500.0))
    return F.lit(2 * K.PLANCK_H * K.LIGHT_C**2) / F.pow(w, F.lit(5.0)) / (F.exp(x) - 1)


def planck_um(wavelength: Column | float, t: Column) -> Column:
    return planck_m(wavelength, t) * 1e-6


def wien_peak(t: Column) -> Column:
    return F.lit(K.WIEN_B) / t


def exitance(t: Column) -> Column:
    return F.lit(K.STEFAN_BOLTZMANN) * F.pow(t, F.lit(4.0))


def source_area(esf: Column) -> Column:
    return esf * K.PIXEL_AREA_M2


def radiant_heat(area: Column, t: Column) -> Column:
    return area * exitance(t) / 1e6


def source_class(t: Column) -> Column:
    """Class by temperature; a NULL temperature is a failed fit."""
    c = F.when(t.isNull(), K.FAILED_CLASS)
    for limit, name in K.CLASSES:
        c = c.when(t > limit, name)
    return c.otherwise(K.COLDEST_CLASS)


def basin(lat: Column, lon: Column) -> Column:
    """First box that holds the point, else 'Other'."""
    c = F
    for name, south, north, west, east in K.BASINS:
        c = c.when(in_box(lat, lon, (south, north, west, east)), name)
    return c.otherwise("Other")


def backfilled_basin(known: Column, lat: Column, lon: Column) -> Column:
    return F.coalesce(known, basin(lat, lon))


def bcm(heat_mw: Column) -> Column:
    return heat_mw * K.BCM_PER_MW


def mmscfd(heat_mw: Column) -> Column:
    return bcm(heat_mw) * K.MMSCF_PER_BCM


def grid(x: Column) -> Column:
    """Site grid index, half to even."""
    return F.rint(x / K.SITE_STEP)


def site_key(lat: Column, lon: Column) -> Column:
    """The rounded position as text; NULL coordinates make the key NULL."""
    return F.concat((grid(lat) * K.SITE_STEP).cast("string"), F.lit(","), (grid(lon) * K.SITE_STEP).cast("string"))


def site_text(lat: Column, lon: Column) -> Column:
    """The grid position in whole steps, as text that does not hang on how an engine prints fractions."""
    return F.concat(grid(lat).cast("long").cast("string"), F.lit(","), grid(lon).cast("long").cast("string"))


def half_even(x: Column, digits: int = 1) -> Column:
    return F.rint(x * float(10**digits)) / float(10**digits)


def persistence(days_seen: Column, nights: Column) -> Column:
    return half_even(days_seen / F.greatest(nights, F.lit(1)) * 100.0, 1)


def acquired(name: Column) -> Column:
    """Acquisition time from a granule file name, NULL if the name has none."""
    pattern = r"VJ10[23]MOD\.A(\d{4})(\d{3})\.(\d{2})(\d{2})"
    part = lambda k: F.regexp_extract(name, pattern, k)
    stamp = F.try_to_timestamp(F.concat(part(1), F.lit("-01-01 "), part(3), F.lit(":"), part(4), F.lit(":00")))
    days = F.when(part(2) != "", part(2).cast("int"))
    return F.when(days >= 1, F.timestamp_add("DAY", days - 1, stamp))


def key_time(key: Column) -> Column:
    """Acquisition time from a granule key, NULL if it is none."""
    return acquired(F.concat(F.lit("VJ102MOD."), key))


def granule_key(name: Column) -> Column:
    """Second and third dot part of a file name, NULL with fewer than three parts."""
    parts = F.split(name, r"\.")
    return F.when(F.size(parts) >= 3, F.concat_ws(".", F.get(parts, F.lit(1)), F.get(parts, F.lit(2))))


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def map_marker(heat: Column) -> Column:
    return F.least(F.greatest(heat, F.lit(0.1)), F.lit(50.0)) * 10


def frame_marker(heat: Column, p98: Column) -> Column:
    return F.least(F.greatest(heat / p98, F.lit(0.02)), F.lit(1.0)) * 80


def zoom(span: Column) -> Column:
    return F.when(span < 3, 7).when(span < 8, 6).when(span < 15, 5).otherwise(3)


def padding(span: Column) -> Column:
    return F.greatest(span * 0.08, F.lit(0.5))
