"""Filters, persistence, calendars and ranks on small tables."""

import datetime as dt

import pytest

from emberscan.operators import analytics as A

SCHEMA = "datetime_utc timestamp, latitude double, longitude double, basin string, granule string, row int, col int, temperature_K double, radiant_heat_MW double, source_area_m2 double, classification string"


def rows(spark, *items):
    out = []
    for day, lat, t, rh in items:
        cls = "gas_flare" if t and t > 1400 else "fit_failed" if t is None else "smoldering"
        out.append((dt.datetime(2024, 1, day, 3), lat, -103.0, None, f"g{day}", 1, day, t, rh, 5.0, cls))
    return A.enrich(spark.createDataFrame(out, SCHEMA))


def test_filters_drop_nulls_and_keep_edges(spark):
    df = rows(spark, (1, 31.0, 600.0, 1.0), (1, 31.0, None, None), (2, 31.0, 2200.0, 20.0), (3, 31.0, 599.9, 1.0))
    got = A.select_detections(df, temperature=(600, 2200), heat=(1, 20)).collect()
    assert sorted(r.temperature_K for r in got) == [600.0, 2200.0]
    assert A.select_detections(df, dates=("2024-01-02", "2024-01-03"), basins=["Permian"]).count() == 2
    assert A.select_detections(df, classes=[]).count() == 0


def test_persistence(spark):
    df = rows(spark, (1, 31.0, 900.0, 1.0), (2, 31.0, 900.0, 1.0), (3, 31.0, 900.0, 1.0), (3, 32.0, 900.0, 1.0), (3, 32.0, 901.0, 1.0))
    got = {(r.latitude, r.date.day): (r.days_seen, r.persistence) for r in A.with_persistence(df).collect()}
    assert got[(31.0, 2)] == (3, 100.0) and got[(32.0, 3)] == (1, 33.3)
    assert A.with_persistence(df.limit(0)).count() == 0


def test_default_ranges_truncate(spark):
    r = A.default_ranges(rows(spark, (1, 31.0, 600.7, 1.0), (1, 31.0, 1900.9, 90.0))).first()
    assert (r.t_min, r.t_max, r.rh_max) == (600, 1900, 20.0)


def test_kpis_and_volume_use_nights_before_persistence(spark):
    df = rows(spark, (1, 31.0, 1500.0, 2.0), (2, 32.0, 900.0, 4.0))
    k = A.kpis(df.filter("latitude = 31"), A.nights(df)).first()
    assert (k.n_detections, k.n_flares, k.sum_rh) == (1, 1, 2.0)
    assert k.avg_mmscfd == pytest.approx(0.029353 * 2 * 35314.667 / 2)
    v = A.volume_summary(df, A.nights(df)).first()
    assert v.peak_mmscfd == pytest.approx(0.029353 * 4 * 35314.667) and v.annual_bscf == pytest.approx(v.avg_mmscfd * 0.365)
    none = A.volume_summary(df.limit(0), A.nights(df.limit(0))).first()
    assert none.peak_mmscfd == 0 and none.annual_bscf is None


def test_top_ties_and_nulls(spark):
    df = rows(spark, (3, 31.0, 900.0, 5.0), (1, 31.0, 900.0, 5.0), (2, 31.0, None, None), (4, 31.0, 900.0, 9.0))
    got = A.top_by_heat(df, 4).orderBy("rank").collect()
    assert [r.granule for r in got] == ["g4", "g1", "g3", "g2"] and [r["rank"] for r in got] == [1, 2, 3, 4]


def test_calendar_fills_gaps(spark):
    df = rows(spark, (1, 31.0, 900.0, 5.0), (2, 31.0, 900.0, 5.0), (5, 31.0, 900.0, 5.0))
    filled = A.filled_calendar(df).filter("placeholder").collect()
    assert sorted(r.date.day for r in filled) == [3, 4] and {r.radiant_heat_MW for r in filled} == {0.0}
    assert A.calendar(df.limit(0)).count() == 0


def test_percentile_interpolates(spark):
    df = rows(spark, *[(1, 31.0, 900.0, float(k)) for k in range(1, 11)])
    assert A.heat_p98(df).first().p98 == pytest.approx(9.82)
    assert A.heat_p98(df.limit(0)).first().p98 == 1.0


def test_histogram_holds_its_upper_edge(spark):
    df = rows(spark, *[(1, 31.0, 900.0, x) for x in (0.0, 2.5, 5.0)])
    got = {r.bin: r.n for r in A.histogram(df, "radiant_heat_MW", 0, 5, bins=2).collect()}
    assert got == {0: 1, 1: 2}


def test_basin_backfill(spark):
    df = rows(spark, (1, 31.0, 900.0, 1.0))
    assert df.first().basin == "Permian"


def test_map_extent(spark):
    df = rows(spark, (1, 31.0, 900.0, 1.0), (1, 33.0, 900.0, 1.0))
    assert tuple(A.map_extent(df).first()) == (30.5, 33.5, -103.5, -102.5)
    assert tuple(A.map_extent(df, (1, 2, 3, 4)).first()) == (1.0, 2.0, 3.0, 4.0)


def test_persistence_keeps_detections_without_coordinates(spark):
    df = rows(spark, (1, 31.0, 900.0, 1.0), (2, None, 900.0, 1.0), (2, None, 950.0, 1.0))
    got = {(r.latitude, r.temperature_K): (r.days_seen, r.persistence) for r in A.with_persistence(df).collect()}
    assert got == {(31.0, 900.0): (1, 50.0), (None, 900.0): (1, 50.0), (None, 950.0): (1, 50.0)}


def test_quantiles_by_brackets(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(A, "SORTED_VALUES", 50)
    rng = np.random.default_rng(1)
    for values in (rng.gamma(1, 3, 5000), np.round(rng.gamma(1, 3, 5000), 1), np.full(500, 7.0), np.r_[np.zeros(4990), np.arange(10.0)], np.array([3.0])):
        df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "x double").repartition(3)
        for q in (0.0, 0.5, 0.98, 1.0):
            assert A.exact_quantile(df, "x", q) == pytest.approx(np.quantile(values, q), rel=1e-12)
    assert A.exact_quantile(df.limit(0), "x", 0.5) is None


def test_histogram_takes_its_edges_from_the_data(spark):
    df = rows(spark, *[(1, 31.0, 900.0, x) for x in (-2.0, 0.0, 3.0, 8.0, 50.0)])
    assert {r.bin: r.n for r in A.histogram(df, "radiant_heat_MW", bins=2, below=10).collect()} == {0: 2, 1: 2}
    assert [(r.bin, r.n) for r in A.histogram(df, "temperature_K").collect()] == [(0, 5)]
    assert A.histogram(df.limit(0), "temperature_K").count() == 0
