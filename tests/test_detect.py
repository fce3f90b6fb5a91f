"""Clipping, hot pixels, local background on hand-made pixels."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberscan.operators import detect as D

SCHEMA = "granule_key string, row int, col int, latitude double, longitude double, solar_zenith double, M07 double, M08 double, M10 double, M11 double, M12 double, M13 double, M14 double"


def raster(spark, m10, m12=None, m13=None, key="g"):
    m10 = np.asarray(m10, float)
    rows = []
    for r in range(m10.shape[0]):
        for c in range(m10.shape[1]):
            pick = lambda a: None if a is None or a[r][c] is None else float(a[r][c])
            v = None if np.isnan(m10[r, c]) else float(m10[r, c])
            rows.append((key, r, c, 30.0, -100.0, 120.0, v, v, v, v, pick(m12), pick(m13), 1.0))
    return spark.createDataFrame(rows, SCHEMA)


def clipped(values):
    v = np.array([x for x in values if x > 0])
    for _ in range(3):
        if not len(v) or v.std() == 0:
            break
        kept = v[v < v.mean() + 5 * v.std()]
        if len(kept) == len(v):
            break
        v = kept
    return v.mean(), v.std(), len(v)


def test_zonal_stats_match_iterative_clipping(spark):
    rng = np.random.default_rng(1)
    m = rng.gamma(2, 1, (20, 30))
    m[3, 4], m[5, 6], m[7, 8:12] = 900, 80, 25
    m[0, 0], m[0, 1] = np.nan, -1
    got = D.zonal_stats(raster(spark, m)).collect()
    assert len(got) == 1 and got[0].zone == 0
    mean, std, n = clipped(m[~np.isnan(m)])
    assert (got[0]["mean"], got[0]["std"], got[0].n_pixels) == pytest.approx((mean, std, n))
    assert got[0].threshold == pytest.approx(mean + 4 * std)


def test_constant_one_pixel_and_empty_zones(spark):
    same = D.zonal_stats(raster(spark, np.full((2, 3), 7.0))).first()
    assert (same["mean"], same["std"], same.n_pixels) == (7.0, 0.0, 6)
    assert D.zonal_stats(raster(spark, [[3.0]])).first().n_pixels == 1
    assert D.zonal_stats(raster(spark, [[np.nan, -2.0]])).count() == 0


def test_hot_is_strict(spark):
    px = raster(spark, [[1.0, 2.0, 3.0]])
    stats = spark.createDataFrame([("g", 0, 2.0)], "granule_key string, zone int, threshold double")
    assert [r.col for r in D.hot_pixels(px, stats).collect()] == [2]


def test_local_background(spark):
    m12 = np.arange(49.0).reshape(7, 7).tolist()
    m13 = np.ones((7, 7)).tolist()
    m12[0][1] = None
    px = raster(spark, np.ones((7, 7)), m12, m13)
    hot = px.filter("(row = 0 and col = 0) or (row = 3 and col = 3)")
    got = {(r.row, r.col): r for r in D.local_background(px, hot).collect()}
    inside = [m12[r][c] for r in range(6) for c in range(6) if (r, c) not in ((0, 0), (3, 3), (0, 1))]
    assert got[(0, 0)].n_bg == len(inside) and got[(0, 0)].bg_m12 == pytest.approx(np.mean(inside))
    assert got[(0, 0)].sd_m12 == pytest.approx(np.std(inside)) and got[(3, 3)].n_bg == 46
    assert not got[(0, 0)].detected_M12


def test_too_few_neighbours(spark):
    px = raster(spark, [[9.0, 1, 1, 1, 1]], [[9, 1, 1, 1, 1]], [[1, 1, 1, 1, 1]])
    got = D.local_background(px, px.filter("col = 0")).first()
    assert (got.n_bg, got.bg_m12, got.detected_M12) == (0, None, False)


def test_usable_radiances(spark):
    schema = "M07 double, M08 double, M10 double, M11 double, M12 double, M13 double, bg_m12 double, bg_m13 double"
    rows = [(1.0, None, 2.0, -1.0, 5.0, 3.0, 2.0, 4.0), (1.0, 1.0, 1.0, 1.0, 5.0, 3.0, None, None)]
    df = spark.createDataFrame(rows, schema).select(D.usable_radiances(F.col("bg_m12").isNotNull()).alias("b"))
    got = [[(x["band"], x["obs"]) for x in r.b] for r in df.collect()]
    assert got[0] == [("M07", 1.0), ("M10", 2.0), ("M12", 3.0)]
    assert [b for b, _ in got[1]] == ["M07", "M08", "M10", "M11"]


def test_windows_give_what_passes_give(spark, monkeypatch):
    rng = np.random.default_rng(3)
    px = raster(spark, rng.gamma(2, 1, (20, 30))).unionByName(raster(spark, rng.gamma(1, 9, (9, 30)), key="h"))
    px = px.withColumn("M11", F.when(F.col("col") % 7 != 0, F.col("M11") * 3))
    one = sorted(map(str, D.clip_stats(px, ("M10", "M11")).select(*[F.round(c, 9) if c[:2] in ("me", "st") else c for c in D.clip_stats(px, ("M10", "M11")).columns]).collect()))
    monkeypatch.setattr(D.shared, "BROADCAST_ROWS", 0)
    two = sorted(map(str, D.clip_stats(px, ("M10", "M11")).select(*[F.round(c, 9) if c[:2] in ("me", "st") else c for c in D.clip_stats(px, ("M10", "M11")).columns]).collect()))
    assert one == two and len(one) == 2


def test_both_bands_in_one_pass(spark):
    m = np.random.default_rng(4).gamma(2, 1, (15, 20))
    m[3, 4] = 500
    px = raster(spark, m).withColumn("M11", F.col("M11") * 2 + 1)
    both = D.clip_stats(px, ("M10", "M11"))
    for b in ("M10", "M11"):
        got, want = D.band_stats(both, b).first(), D.zonal_stats(px, b).first()
        assert got.n_pixels == want.n_pixels and got.threshold == pytest.approx(want.threshold)


def test_detections_scan_the_pixels_a_few_times_and_shuffle_none(spark, tmp_path):
    """Counts scans by a listener on executed plans, with automatic broadcasts off."""
    from emberscan.plans import detection, views

    views.pixels(spark, "/root/testdata/sf0.001").write.parquet(str(tmp_path / "px"))
    px = spark.read.parquet(str(tmp_path / "px"))
    n = px.count()
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        assert detection.detections(px).count() >= 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    runs = store.executionsList()
    plans = [runs.apply(i).physicalPlanDescription() for i in range(int(before), runs.size())]
    final = [p.split("== Initial Plan ==")[0] for p in plans]
    scans = sum(line.startswith("Location:") and str(tmp_path) in line for p in plans for line in p.splitlines())
    assert 3 <= scans <= 6, scans
    assert n and not any("SortMergeJoin" in p and str(tmp_path) in p for p in final)
