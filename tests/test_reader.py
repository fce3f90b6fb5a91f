"""The granule reader on containers of both libraries, and the run from catalogue to table."""

import datetime as dt
import io
import os

import fake_containers as X
import numpy as np
import pytest
from pyspark.sql import functions as F

from emberscan.functions import constants as K
from emberscan.sources import catalogue, granules, netcdf
from emberscan.streaming import incremental

PLACES = [
    ("observation_data/{}", "geolocation_data/{}", ("latitude", "longitude", "solar_zenith")),
    ("observation_data/{}_Radiance", "geolocation_data/{}", ("Latitude", "Longitude", "SolarZenithAngle")),
    ("All_Data/VIIRS-{}-SDR_All/Radiance", "All_Data/VIIRS-MOD-GEO_All/{}", ("Latitude", "Longitude", "SolarZenithAngle")),
]
SHAPE = (130, 40)


def counts(seed=1):
    raw = np.random.default_rng(seed).integers(200, 600, SHAPE).astype(np.uint16)
    raw[0, :6] = (65535, 65528, 65532, 65527, 0, 1)
    raw[70, 20], raw[100, 3] = 40_000, 30_000
    return raw


def pair(netcdf_like, place=0, bands=K.BANDS, attrs=None, seed=1):
    rad_path, geo_path, names = PLACES[place]
    attrs = attrs or {"radiance_scale_factor": np.array([0.01]), "radiance_add_offset": -0.005, "scale_factor": 99.0, "add_offset": 5.0}
    lat, lon = np.meshgrid(np.linspace(30, 33, SHAPE[0]), np.linspace(-104, -101, SHAPE[1]), indexing="ij")
    rad = X.container(netcdf_like, {rad_path.format(b): (counts(seed), attrs) for b in bands})
    geo = X.container(netcdf_like, {
        geo_path.format(names[0]): (lat, {}), geo_path.format(names[1]): (lon, {}),
        geo_path.format(names[2]): (np.where(np.arange(SHAPE[0])[:, None] == 5, -32768, np.full(SHAPE, 12_000)).astype(np.int16), {"scale_factor": 0.01, "_FillValue": -32768}),
    })
    return rad, geo


def blocks(rad, geo, bands=K.BANDS):
    got = list(netcdf.granule_blocks(rad, geo, bands))
    return {c: np.concatenate([b[c] for b in got]).reshape(SHAPE) for c in got[0]}


@pytest.mark.parametrize("netcdf_like", [True, False])
@pytest.mark.parametrize("place", [0, 1, 2])
def test_paths_and_radiance_attributes(netcdf_like, place):
    got = blocks(*pair(netcdf_like, place))
    raw = counts().astype(float)
    want = raw * 0.01 - 0.005
    want[(raw >= 65528) | (raw == 65535) | (want <= 0)] = np.nan
    for b in K.BANDS:
        assert np.allclose(got[b], want, equal_nan=True)
    assert np.isnan(got["M10"][0, [0, 1, 2, 4]]).all() and np.isfinite(got["M10"][0, 3])
    assert np.isnan(got["solar_zenith"][5]).all() and np.allclose(got["solar_zenith"][6:], 120.0)
    assert (got["row"][:, 0] == np.arange(SHAPE[0])).all() and (got["col"][0] == np.arange(SHAPE[1])).all()


@pytest.mark.parametrize("netcdf_like", [True, False])
def test_general_attributes_and_own_limits(netcdf_like):
    got = blocks(*pair(netcdf_like, attrs={"scale_factor": 0.1, "add_offset": 1.0, "valid_max": 500, "_FillValue": 300}))["M10"]
    raw = counts().astype(float)
    want = np.where((raw >= 501) | (raw == 300), np.nan, raw * 0.1 + 1)
    assert np.allclose(got, want, equal_nan=True)
    plain = blocks(*pair(netcdf_like, attrs={"units": "x"}))["M10"]
    assert np.nanmax(plain) == 65527


@pytest.mark.parametrize("netcdf_like", [True, False])
def test_missing_bands(netcdf_like):
    got = blocks(*pair(netcdf_like, bands=["M10", "M11"]))
    assert np.isnan(got["M13"]).all() and np.isfinite(got["M11"]).any()
    with pytest.raises(KeyError):
        blocks(*pair(netcdf_like, bands=["M11"]))


@pytest.mark.parametrize("netcdf_like", [True, False])
def test_describe_entries(netcdf_like):
    rad, _ = pair(netcdf_like, bands=["M10"])
    got = list(netcdf._entries(rad))
    assert ("/", "attribute", "title", "granule") in got
    names = {(g, n): v for g, kind, n, v in got if kind == "variable"}
    assert "shape=(130, 40)" in names[("/observation_data", "M10")] and "scale=99.0" in names[("/observation_data", "M10")]
    if netcdf_like:
        assert ("/observation_data", "dimension", "samples", "40") in got


class FakeOpen:
    """Workers cannot see this process's containers: they are made anew from a file's name."""

    def __call__(self, path):
        name = os.path.basename(path)
        if not os.path.exists(path) or "0600" in name:
            raise OSError(f"cannot open {name}")
        made = pair(True, seed=int(name[14:17]))
        return made[0] if name.startswith("VJ102") else made[1]


@pytest.fixture
def reader(monkeypatch, spark):
    import cloudpickle_by_value

    return cloudpickle_by_value.use(monkeypatch, netcdf, FakeOpen())


def names(key):
    return [f"VJ10{k}MOD.{key}.021.nc" for k in (2, 3)]


def service(tmp_path, keys, broken=()):
    def opener(request, timeout):
        url = request if isinstance(request, str) else request.full_url
        if "search" in url:
            k = 0 if "VJ102MOD" in url else 1
            return io.BytesIO(("<r>" + "".join(f"<i>{names(x)[k]}</i>" for x in keys) + "</r>").encode())
        if "fileIds" in url:
            ids = url.split("fileIds=")[1].replace("%2C", ",").split(",")
            return io.BytesIO(("<r>" + "".join(f"<u>http://h/{i}</u>" for i in ids) + "</r>").encode())
        if any(b in url for b in broken):
            raise catalogue.urllib.error.URLError("gone")
        return io.BytesIO(b"raw")

    return catalogue.Catalogue("http://h/search", "http://h/files", opener, sleep=lambda s: None)


def test_fetch_and_process(spark, reader, tmp_path):
    table, log, folder = (str(tmp_path / x) for x in ("table", "log", "raw"))
    os.mkdir(folder)
    keys = ["A2024010.0500", "A2024011.0600", "A2024012.0700", "A2024013.0800"]
    steps = []

    def go(broken=()):
        return incremental.fetch_and_process(
            spark, service(tmp_path, keys, broken), dt.date(2024, 1, 10), dt.date(2024, 1, 13), table, log, folder, "t", at_once=3,
            progress=lambda *a: steps.append(a),
        )

    got = go(broken=["A2024013"])
    assert (got["found"], got["pending"], got["processed"]) == (4, 4, 2) and set(got["failed"]) == {"A2024011.0600", "A2024013.0800"}
    assert os.listdir(folder) == [] and steps[-1][:2] == (4, 4)
    found = incremental.read_detections(spark, table, log)
    assert {(r.granule, r.datetime_utc) for r in found.select("granule", "datetime_utc").distinct().collect()} == {
        ("A2024010.0500", dt.datetime(2024, 1, 10, 5)), ("A2024012.0700", dt.datetime(2024, 1, 12, 7))
    }
    assert {(r.row, r.col) for r in found.filter("granule = 'A2024010.0500'").collect()} >= {(70, 20), (100, 3)}
    again = go()
    assert (again["pending"], again["processed"], set(again["failed"])) == (2, 1, {"A2024011.0600"})
    assert {r[0] for r in granules.read_processed(spark, log).collect()} == {"A2024010.0500", "A2024012.0700", "A2024013.0800"}
    assert incremental.fetch_and_process(spark, service(tmp_path, []), dt.date(2024, 1, 1), dt.date(2024, 1, 1), table, log, folder, "t")["found"] == 0


def test_a_granule_outside_the_region_is_done(spark, reader, tmp_path):
    (tmp_path / "f").mkdir()
    paths = []
    for n in names("A2024010.0500"):
        (tmp_path / "f" / n).write_text("raw")
        paths.append(str(tmp_path / "f" / n))
    pairs = spark.createDataFrame([("A2024010.0500", *paths)], "granule_key string, rad_path string, geo_path string")
    done, failed = incremental.run_pairs(pairs, str(tmp_path / "t"), str(tmp_path / "l"), str(tmp_path / "s"), box=(0, 1, 0, 1))
    assert done.count() == 1 and failed.count() == 0
    assert incremental.run_pairs(pairs, str(tmp_path / "t"), str(tmp_path / "l"), str(tmp_path / "s"))[0].count() == 0
    described = netcdf.describe(spark.createDataFrame([(p,) for p in paths], "path string"))
    assert described.filter(F.col("name") == "M10").count() == 1
