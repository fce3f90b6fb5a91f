"""Planck fits recover what made the radiances."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from emberscan.functions import constants as K
from emberscan.operators import fit


def radiances(t, esf, bands=K.SWIR_BANDS):
    return {b: float(esf * fit.planck(np.array(K.WAVELENGTHS[b]), np.array(t))) for b in bands}


def solve(obs):
    return fit._fit_rows([[{"band": b, "w": K.WAVELENGTHS[b], "obs": v} for b, v in obs.items()]])[0]


@pytest.mark.parametrize("t, esf, tol", [(1800, 1e-6, 1), (900, 5e-5, 1), (2600, 1e-8, 1), (600, 1e-3, 1)])
def test_clean_sources(t, esf, tol):
    got = solve(radiances(t, esf))
    assert got["success"] and abs(got["temperature_K"] - t) < tol and got["esf"] == pytest.approx(esf, rel=0.01)
    assert got["radiant_heat_MW"] == pytest.approx(got["source_area_m2"] * K.STEFAN_BOLTZMANN * got["temperature_K"] ** 4 / 1e6)


def test_noise():
    noise = 1 + 0.1 * np.random.default_rng(42).standard_normal(4)
    got = solve({b: max(v * n, 0) for (b, v), n in zip(radiances(1800, 1e-6).items(), noise)})
    assert abs(got["temperature_K"] - 1800) < 300


def test_band_counts_and_guards():
    assert solve(radiances(1800, 1e-6, ["M10", "M11"]))["success"]
    assert not solve({"M10": 1e-5})["success"]
    assert not solve({})["success"]
    assert not solve({"M10": -1.0, "M11": 2.0})["success"]
    assert solve({"M10": 1e6, "M11": 1e6})["error"] == "start outside the bounds"
    assert solve({"M07": 1e-8, "M08": 5e-7, "M10": 1e-5, "M11": 3e-5})["radiant_heat_MW"] > 0


@settings(max_examples=30, deadline=None)
@given(st.floats(500, 3500), st.floats(-9, -4), st.integers(0, 2**31))
def test_cost_is_no_worse_than_at_the_truth(t, log_esf, seed):
    noise = 1 + 0.05 * np.random.default_rng(seed).uniform(-1, 1, 4)
    obs = {b: v * n for (b, v), n in zip(radiances(t, 10**log_esf).items(), noise)}
    got = solve(obs)
    res = [(10**log_esf * fit.planck(np.array(K.WAVELENGTHS[b]), np.array(t)) - o) / (o + 1e-20) for b, o in obs.items()]
    assert got["cost"] <= 0.5 * sum(float(r) ** 2 for r in res) + 1e-9


def test_udf_and_grid_agree(spark):
    rows = [tuple(radiances(t, e).values()) for t, e in ((1800, 1e-6), (900, 5e-5), (1234, 1e-7))]
    df = spark.createDataFrame(rows, ", ".join(f"{b} double" for b in K.SWIR_BANDS))
    bands = F.array(*[F.struct(F.lit(b).alias("band"), F.lit(K.WAVELENGTHS[b]).alias("w"), F.col(b).alias("obs")) for b in K.SWIR_BANDS])
    got = df.select(fit.planck_fit(bands).alias("f"), fit.grid_fit({b: F.col(b) for b in K.SWIR_BANDS}).alias("g")).collect()
    for r, t in zip(got, (1800, 900, 1234)):
        assert r.f.success and abs(r.f.temperature_K - t) < 1 and abs(r.g.t - t) <= 20
        assert r.f.bands_used == K.SWIR_BANDS and set(r.f.residuals) == set(K.SWIR_BANDS)


def test_failed_rows_have_a_class(spark):
    df = spark.createDataFrame([(1, [])], "id int, fit_bands array<struct<band:string,w:double,obs:double>>")
    r = fit.with_fit(df).first()
    assert (r.classification, r.n_bands_used, r.temperature_K) == ("fit_failed", 0, None)
