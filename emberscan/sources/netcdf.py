"""Optional reader of granule containers (NetCDF4 or HDF5) into pixel rows.

Needs netCDF4 or h5py on the executors; without them ``read_pixels`` raises
ImportError when it runs.  One file pair is one task's unit, read in blocks of
scan lines, so memory does not grow with a granule.

Counts are unpacked here, whichever library reads them: radiances by their own
scale and offset attributes, else by the general ones; angles and coordinates by
the general ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..functions import constants as K

# Where variables may lie, in order of preference, and their attributes.
RADIANCE_PATHS = ("observation_data/{band}", "observation_data/{band}_Radiance", "All_Data/VIIRS-{band}-SDR_All/Radiance")
LATITUDE_PATHS = ("geolocation_data/latitude", "geolocation_data/Latitude", "All_Data/VIIRS-MOD-GEO_All/Latitude")
LONGITUDE_PATHS = ("geolocation_data/longitude", "geolocation_data/Longitude", "All_Data/VIIRS-MOD-GEO_All/Longitude")
ZENITH_PATHS = ("geolocation_data/solar_zenith", "geolocation_data/SolarZenithAngle", "All_Data/VIIRS-MOD-GEO_All/SolarZenithAngle")
RADIANCE_SCALE, RADIANCE_OFFSET = ("radiance_scale_factor", "scale_factor"), ("radiance_add_offset", "add_offset")

#: Scan lines of one block.
LINES = 64
#: The band without which a granule cannot be judged; any other may be absent.
NEEDED = "M10"


def _open(path: str):
    try:
        import netCDF4

        ds = netCDF4.Dataset(path)
        ds.set_auto_maskandscale(False)
        return ds
    except ImportError:
        import h5py

        return h5py.File(path, "r")


def _lookup(ds, path: str):
    """A variable by its path, in either library; KeyError if it is not there."""
    if not hasattr(ds, "variables"):
        return ds[path]
    *groups, name = path.split("/")
    for g in groups:
        ds = ds.groups[g]
    return ds.variables[name]


def first_variable(ds, paths):
    for path in paths:
        try:
            return _lookup(ds, path)
        except (KeyError, IndexError):
            continue
    raise KeyError(f"none of {list(paths)} is present")


def attributes(v) -> dict:
    return dict(v.attrs) if hasattr(v, "attrs") else {k: v.getncattr(k) for k in v.ncattrs()}


def _number(attrs: dict, names, default):
    found = next((attrs[n] for n in names if n in attrs), default)
    return None if found is None else float(np.asarray(found).ravel()[0])


def radiance(v, lines: slice) -> np.ndarray:
    """Radiances of some scan lines; fill, flagged and non-positive values are NaN."""
    attrs = attributes(v)
    raw = np.asarray(v[lines], np.float64)
    out = raw * _number(attrs, RADIANCE_SCALE, 1.0) + _number(attrs, RADIANCE_OFFSET, 0.0)
    bad = (raw >= _number(attrs, ("valid_max",), K.VALID_MAX) + 1) | (raw == _number(attrs, ("_FillValue",), K.FILL_VALUE))
    return np.where(bad | (out <= 0), np.nan, out)


def physical(v, lines: slice) -> np.ndarray:
    """Coordinates or angles of some scan lines; fill values are NaN."""
    attrs = attributes(v)
    raw = np.asarray(v[lines], np.float64)
    out = raw * _number(attrs, ("scale_factor",), 1.0) + _number(attrs, ("add_offset",), 0.0)
    fill = _number(attrs, ("_FillValue",), None)
    return out if fill is None else np.where(raw == fill, np.nan, out)


def _schema(bands) -> str:
    return "granule_key string, row int, col int, latitude double, longitude double, solar_zenith double, error string, " + ", ".join(f"{b} double" for b in bands)


def granule_blocks(rad, geo, bands) -> Iterator[dict[str, np.ndarray]]:
    """Pixel columns of an open pair, block by block in row-major order."""
    lat, lon, sza = (first_variable(geo, p) for p in (LATITUDE_PATHS, LONGITUDE_PATHS, ZENITH_PATHS))
    found = {}
    for b in bands:
        try:
            found[b] = first_variable(rad, [p.format(band=b) for p in RADIANCE_PATHS])
        except KeyError:
            if b == NEEDED:
                raise
            found[b] = None
    n, width = lat.shape
    for at in range(0, n, LINES):
        lines = slice(at, min(at + LINES, n))
        rows, cols = np.divmod(np.arange(at * width, lines.stop * width), width)
        block = {
            "row": rows.astype(np.int32), "col": cols.astype(np.int32), "latitude": physical(lat, lines).ravel(),
            "longitude": physical(lon, lines).ravel(), "solar_zenith": physical(sza, lines).ravel(),
        }
        for b, v in found.items():
            block[b] = np.full(len(rows), np.nan) if v is None else radiance(v, lines).ravel()
        yield block


def read_pixels(pairs: DataFrame, bands=None) -> DataFrame:
    """(granule_key, rad_path, geo_path) -> pixels.

    A pair that cannot be read, or not to its end, gives one row with ``error``,
    its other columns NULL, perhaps after some of its pixels; other pairs go on.
    """
    bands = list(bands or K.BANDS)
    kinds = {"granule_key": pa.string(), "row": pa.int32(), "col": pa.int32(), "error": pa.string()}
    names = ["granule_key", "row", "col", "latitude", "longitude", "solar_zenith", "error", *bands]

    def batch_of(key, n, cols) -> pa.RecordBatch:
        cols = {"granule_key": [key] * n, **cols}
        return pa.RecordBatch.from_arrays(
            [pa.array(cols.get(c, [None] * n), kinds.get(c, pa.float64()), from_pandas=True) for c in names], names
        )

    def rows(batches):
        for batch in batches:
            for p in batch.to_pylist():
                opened = []
                try:
                    for path in (p["rad_path"], p["geo_path"]):
                        opened.append(_open(path))
                    for block in granule_blocks(*opened, bands):
                        yield batch_of(p["granule_key"], len(block["row"]), block)
                except ImportError:
                    raise
                except Exception as e:  # noqa: BLE001  the other granules go on
                    yield batch_of(p["granule_key"], 1, {"error": [f"{type(e).__name__}: {e}"]})
                finally:
                    for ds in opened:
                        ds.close()

    return pairs.select("granule_key", "rad_path", "geo_path").mapInArrow(rows, _schema(bands))


def _entries(ds, group: str = "") -> Iterator[tuple[str, str, str, str]]:
    """(group, kind, name, value) of all that a container holds."""
    if hasattr(ds, "variables"):
        if not group:
            yield from (("/", "attribute", a, str(ds.getncattr(a))) for a in ds.ncattrs())
        yield from ((group or "/", "dimension", n, str(len(d))) for n, d in ds.dimensions.items())
        variables, groups = ds.variables.items(), ds.groups.items()
    else:
        if not group:
            yield from (("/", "attribute", a, str(v)) for a, v in dict(getattr(ds, "attrs", {})).items())
        items = [(k, ds[k]) for k in ds]
        variables = [(k, v) for k, v in items if hasattr(v, "dtype")]
        groups = [(k, v) for k, v in items if not hasattr(v, "dtype")]
    for name, v in variables:
        attrs = attributes(v)
        info = f"shape={tuple(v.shape)} dtype={v.dtype}"
        for label, key in (("units", "units"), ("scale", "scale_factor"), ("offset", "add_offset"), ("fill", "_FillValue")):
            if key in attrs:
                info += f" {label}={attrs[key]}"
        yield group or "/", "variable", name, info
    for name, g in groups:
        yield from _entries(g, f"{group}/{name}")


def describe(files: DataFrame) -> DataFrame:
    """(path) -> (path, group, kind, name, value): attributes, dimensions and variables of every container."""

    def rows(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                ds = _open(path)
                try:
                    got = [(path, *e) for e in _entries(ds)]
                finally:
                    ds.close()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.string()) for c in (zip(*got) if got else ([],) * 5)], ["path", "group", "kind", "name", "value"]
                )

    return files.select("path").mapInArrow(rows, "path string, group string, kind string, name string, value string")
