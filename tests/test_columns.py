"""Scalar rules on literal rows."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberscan.functions import columns as C
from emberscan.functions import constants as K
from emberscan.operators.fit import planck


def values(spark, rows, schema, *cols):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*cols).collect()]


def test_nan_becomes_null(spark):
    got = values(spark, [(1.0,), (None,), (float("nan"),), (float("inf"),)], "v double", C.clean(F.col("v")))
    assert got == [(1.0,), (None,), (None,), (None,)]


def test_zone_edges(spark):
    cols = [0, 639, 640, 1007, 1008, 2191, 2192, 2559, 2560, 3199, 3200]
    got = values(spark, [(c,) for c in cols], "c int", C.zone(F.col("c")))
    assert [g[0] for g in got] == [0, 0, 1, 1, 2, 2, 3, 3, 4, 4, None]
    assert values(spark, [(5000,)], "c int", C.zone(F.col("c"), None)) == [(0,)]


def test_calibration(spark):
    rows = [(r, 0.01) for r in (0, 1, 65527, 65528, 65532, 65535)]
    got = [g[0] for g in values(spark, rows, "r int, s double", C.calibrate(F.col("r"), F.col("s"), F.lit(0.0)))]
    assert got[0] is None and got[1] == pytest.approx(0.01) and got[2] == pytest.approx(655.27) and got[3:] == [None] * 3
    assert values(spark, [(5,)], "r int", C.calibrate(F.col("r"), F.lit(1.0), F.lit(-5.0))) == [(None,)]


def test_night_and_box_edges(spark):
    got = values(spark, [(100.0,), (100.0001,)], "z double", C.night(F.col("z")))
    assert got == [(False,), (True,)]
    s, n, w, e = K.CONUS
    rows = [(s, w), (n, e), (s - 1e-9, w), (n, e + 1e-9)]
    assert [g[0] for g in values(spark, rows, "a double, b double", C.in_box(F.col("a"), F.col("b")))] == [True, True, False, False]


def test_classes(spark):
    t = [500.0, 500.1, 700.0, 700.1, 900.0, 1000.0, 1000.1, 1200.0, 1400.0, 1400.1, 1500.0, 1800.0, None]
    got = [g[0] for g in values(spark, [(x,) for x in t], "t double", C.source_class(F.col("t")))]
    low, smo, bio, ind, fla = "low_temperature_anomaly", "smoldering", "biomass_burning", "industrial_or_large_fire", "gas_flare"
    assert got == [low, smo, smo, bio, bio, bio, ind, ind, ind, fla, fla, fla, "fit_failed"]


def test_basins(spark):
    points = [(30.0, -100.5), (42.5, -104.5), (47.0, -103.0), (47.0, -101.5), (40.0, -80.0), (38.0, -82.5), (0.0, 0.0)]
    got = [g[0] for g in values(spark, points, "a double, b double", C.basin(F.col("a"), F.col("b")))]
    assert got == ["Permian", "DJ/Niobrara", "Bakken", "Williston", "Marcellus/Utica", "Appalachian", "Other"]


def test_planck_positive_and_rising(spark):
    rows = [(w * 1e-6, t) for w in (0.865, 1.61, 3.7) for t in (500.0, 1000.0, 1800.0, 3000.0)]
    got = [g[0] for g in values(spark, rows, "w double, t double", C.planck_m(F.col("w"), F.col("t")))]
    assert all(g > 0 for g in got)
    rising = [g[0] for g in values(spark, [(t,) for t in (500.0, 1000.0, 1500.0, 2000.0, 2500.0)], "t double", C.planck_m(1.61e-6, F.col("t")))]
    assert rising == sorted(rising) and len(set(rising)) == 5


def test_wien_and_integral(spark):
    assert 1.0 < values(spark, [(1800.0,)], "t double", C.wien_peak(F.col("t")))[0][0] * 1e6 < 2.0
    w = np.linspace(0.1, 50, 10_000) * 1e-6
    total = np.trapezoid(planck(w, np.array(1800.0)) * 1e6, w)
    assert 0.95 < total / (K.STEFAN_BOLTZMANN * 1800**4 / np.pi) < 1.05


def test_column_and_numpy_planck_agree(spark):
    got = values(spark, [(900.0,), (2500.0,)], "t double", *[C.planck_um(K.WAVELENGTHS[b], F.col("t")) for b in K.BANDS])
    for row, t in zip(got, (900.0, 2500.0)):
        assert row == pytest.approx([float(planck(np.array(K.WAVELENGTHS[b]), np.array(t))) for b in K.BANDS], rel=1e-9)


def test_volume(spark):
    got = values(spark, [(100.0,)], "h double", C.bcm(F.col("h")), C.mmscfd(F.col("h")))
    assert got[0] == pytest.approx((2.9353, 2.9353 * 35314.667))


def test_rounding_is_half_even(spark):
    got = values(spark, [(0.25,), (0.35,), (-0.25,)], "x double", C.half_even(F.col("x")))
    assert [g[0] for g in got] == pytest.approx([0.2, 0.4, -0.2])
    assert values(spark, [(0.0075 * 2.5,)], "x double", C.grid(F.col("x")))[0][0] == 2.0


def test_file_names(spark):
    rows = [("VJ102MOD.A2024001.0006.021.nc",), ("VJ103MOD.A2024366.2354.021.nc",), ("odd",), ("a.b",), ("VJ102MOD.A2024000.0000.nc",)]
    got = values(spark, rows, "n string", C.acquired(F.col("n")), C.granule_key(F.col("n")))
    assert got[0] == (dt.datetime(2024, 1, 1, 0, 6), "A2024001.0006")
    assert got[1] == (dt.datetime(2024, 12, 31, 23, 54), "A2024366.2354")
    assert got[2] == (None, None) and got[3] == (None, None) and got[4][0] is None


def test_first_present():
    with pytest.raises(KeyError):
        C.first_present(["a"], ["b", "c"])
