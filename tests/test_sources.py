"""Files, logs, connector, incremental runs and sinks."""

import datetime as dt
import io
import urllib.error

import pytest
from pyspark.sql import functions as F

from emberscan.plans import views
from emberscan.plans.detection import detections
from emberscan.sources import catalogue, granules, tables
from emberscan.streaming import incremental


def test_pairing(spark):
    rad = spark.createDataFrame([("a/VJ102MOD.A1.01.nc",), ("b/VJ102MOD.A1.01.nc",), ("a/VJ102MOD.A2.02.nc",), ("x",)], "path string")
    geo = spark.createDataFrame([("a/VJ103MOD.A1.01.nc",), ("z/VJ103MOD.A1.01.nc",), ("a/VJ103MOD.A3.03.nc",)], "path string")
    got = granules.pair_granules(rad, geo).collect()
    assert sorted((r.granule_key, r.rad_path[0], r.geo_path[0]) for r in got) == [("A1.01", "a", "z"), ("A1.01", "b", "z")]
    assert granules.pair_granules(rad, geo, unique_left=True).first().rad_path[0] == "b"
    done = spark.createDataFrame([("A1.01",)], "granule_key string")
    assert granules.pending(granules.pair_granules(rad, geo), done).count() == 0


def test_processed_log(spark, tmp_path):
    path = str(tmp_path / "log")
    assert granules.read_processed(spark, path).count() == 0
    keys = spark.createDataFrame([("k1",), ("k1",), ("k2",)], "granule_key string")
    granules.log_processed(keys, path)
    granules.log_processed(keys, path)
    assert granules.read_processed(spark, path).count() == 2


def test_calibrated(spark):
    raw = spark.createDataFrame([("g", 0, 0, 100, 65535)], "granule_key string, row int, col int, raw_M10 int, raw_M11 int")
    cal = spark.createDataFrame(
        [("g", "M10", 0.1, 1.0, 65535, 65527), ("g", "M11", 0.1, 1.0, None, None)],
        "granule_key string, band string, scale double, offset double, fill int, valid_max int",
    )
    got = granules.calibrated(raw, cal).first()
    assert got.M10 == pytest.approx(11.0) and got.M11 is None


def test_chunks_and_retries():
    got = list(catalogue.chunks(dt.date(2024, 1, 1), dt.date(2024, 1, 16)))
    assert [(b - a).days for a, b in got] == [6, 6, 1] and got[-1][1] == dt.date(2024, 1, 16)
    waits, calls = [], []

    def failing():
        calls.append(1)
        raise urllib.error.URLError("down")

    with pytest.raises(urllib.error.URLError):
        catalogue.retried(failing, sleep=waits.append)
    assert len(calls) == 3 and waits == [5.0, 10.0]


def test_catalogue(tmp_path):
    asked = []

    def opener(request, timeout):
        url = request if isinstance(request, str) else request.full_url
        asked.append(url)
        if "search" in url:
            return io.BytesIO(b"<r><a>1</a><a>No results</a></r>" if len(asked) > 1 else b"<r><a>2</a></r>")
        return io.BytesIO(b"<r><u>http://x/f.nc</u><u>none</u></r>") if "fileIds" in url else io.BytesIO(b"data")

    c = catalogue.Catalogue("http://h/search", "http://h/files", opener, sleep=lambda s: None)
    ids = c.search("P", dt.date(2024, 1, 1), dt.date(2024, 1, 10), (1, 2, 3, 4))
    assert ids == ["2", "1"] and c.urls(ids) == ["http://x/f.nc"]
    assert open(c.download("http://x/f.nc", str(tmp_path), "t")).read() == "data"


def test_token(tmp_path, monkeypatch):
    env = tmp_path / ".env"
    env.write_text("# note\nTOKEN_X='abc'\nTOKEN_Y=your_token\n")
    monkeypatch.delenv("TOKEN_X", raising=False)
    assert catalogue.token("TOKEN_X", str(env)) == "abc"
    with pytest.raises(ValueError):
        catalogue.token("TOKEN_Y", str(env))


def test_csv_drops_long_rows_and_pads_short(spark, tmp_path):
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("a", T.IntegerType()), T.StructField("b", T.DoubleType()), T.StructField("c", T.StringType())])
    (tmp_path / "x.csv").write_text('a,b,c\n1,2.5,x\n2,3.5\n3,1,y,extra\n4,NaN,"p,q"\n')
    got = sorted(tuple(r) for r in tables.read_csv(spark, str(tmp_path / "x.csv"), schema).collect())
    assert got == [(1, 2.5, "x"), (2, 3.5, None), (4, None, "p,q")]


def test_append_and_round_trip(spark, tmp_path):
    old = spark.createDataFrame([(1, 2.0)], "row int, temperature_K double")
    new = spark.createDataFrame([(2, True)], "row int, detected_M12 boolean")
    both = tables.append_aligned(old, new)
    assert both.columns == ["row", "temperature_K", "detected_M12"] and both.count() == 2
    full = tables.aligned(both.withColumn("datetime_utc", F.lit("2024-01-02 03:04:00").cast("timestamp")))
    tables.write_csv(full, str(tmp_path / "csv"))
    assert tables.read_csv(spark, str(tmp_path / "csv")).orderBy("row").first().temperature_K == 2.0
    tables.write_parquet(full, str(tmp_path / "pq"))
    assert spark.read.parquet(str(tmp_path / "pq")).count() == 2


def test_kml(spark):
    df = spark.createDataFrame(
        [(1800.4, 1.5, 2.0, "gas_flare", -103.0, 31.0), (None, None, None, "fit_failed", 0.0, 0.0)],
        "temperature_K double, radiant_heat_MW double, source_area_m2 double, classification string, longitude double, latitude double",
    )
    got = tables.kml_rows(df).collect()
    assert len(got) == 1 and got[0].name == "1800K, 1.50MW" and got[0].colour == "ff0000ff"
    assert got[0].description == "Temperature: 1800 K\nRadiant Heat: 1.50 MW\nSource Area: 2.0 m²\nClassification: gas_flare\n"
    others = [df.withColumn("classification", F.lit(c)) for c in ("biomass_burning", "industrial_or_large_fire", "a<b>&c")]
    assert [tables.kml_rows(o).first().colour for o in others] == ["ff00a5ff", "ff00ffff", "ff00ffff"]
    assert "<coordinates>-103.0,31.0,0</coordinates>" in tables.kml_marks(df).first().value


@pytest.fixture
def pixels(spark):
    return views.pixels(spark, "/root/testdata/sf0.001")


def test_detections_schema(spark, pixels):
    got = detections(pixels)
    assert [c for c in tables.SCHEMA.names if c not in got.columns] == []
    rows = got.collect()
    assert rows and all(r.classification for r in rows)
    assert detections(pixels.limit(0)).count() == 0


def test_incremental_is_idempotent(spark, pixels, tmp_path):
    table, log = str(tmp_path / "table"), str(tmp_path / "log")
    steps = []
    assert incremental.read_detections(spark, table, log).count() == 0
    assert incremental.run_new(pixels, table, log, progress=lambda *a: steps.append(a)).count() == 1
    first = incremental.read_detections(spark, table, log).count()
    assert incremental.run_new(pixels, table, log).count() == 0
    incremental.write_batch(detections(pixels), table, "crashed")  # written, never logged
    assert incremental.read_detections(spark, table, log).count() == first > 0 and steps[0][:2] == (0, 1)
    incremental.write_batch(detections(pixels), table, "ffff")
    granules.log_processed(spark.createDataFrame([("0",)], "granule_key string"), log, "zzzz")  # a second run of the same granule
    assert incremental.read_detections(spark, table, log).count() == first


def test_an_unreadable_granule_stays_pending(spark, pixels, tmp_path):
    table, log = str(tmp_path / "table"), str(tmp_path / "log")
    marked = pixels.withColumn("granule_key", F.col("granule_key").cast("string")).withColumn("error", F.lit(None).cast("string"))
    torn = marked.limit(5).withColumn("granule_key", F.lit("torn"))
    bad = marked.limit(1).select(*[(F.lit("torn") if c == "granule_key" else F.lit("broken") if c == "error" else F.lit(None).cast(t)).alias(c) for c, t in marked.dtypes])
    both = marked.unionByName(torn).unionByName(bad)
    assert [r[0] for r in incremental.run_new(both, table, log).collect()] == ["0"]
    assert [tuple(r) for r in incremental.failures(both).collect()] == [("torn", "broken")]
    mended = torn.withColumn("granule_key", F.lit("torn"))
    assert [r[0] for r in incremental.run_new(mended, table, log).collect()] == ["torn"]
    assert incremental.failures(pixels).count() == 0


def test_stream_follows_a_folder(spark, pixels, tmp_path):
    folder, table, log = (str(tmp_path / x) for x in ("in", "table", "log"))
    pixels.write.parquet(folder)
    q = incremental.follow(spark, folder, pixels.schema, table, log, str(tmp_path / "ckpt"))
    assert q.awaitTermination(120)
    assert incremental.read_detections(spark, table, log).count() > 0 and granules.read_processed(spark, log).count() == 1


def test_hourly_stream(spark, tmp_path):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 1, 3, 5), None, 31.0, -103.0, 2.0)], "datetime_utc timestamp, basin string, latitude double, longitude double, radiant_heat_MW double")
    df.write.parquet(str(tmp_path / "in"))
    q = incremental.hourly_heat(spark, str(tmp_path / "in"), df.schema).writeStream.format("memory").queryName("hh").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    r = spark.table("hh").first()
    assert (r.basin, r.sum_rh, r.n) == ("Permian", 2.0, 1)


def test_kml_document_is_valid(spark, tmp_path):
    import xml.etree.ElementTree as ET

    rows = [(1800.4 + k, 1.5, None if k else 2.0, "a<b>&c", -103.0, 31.0) for k in range(50)]
    df = spark.createDataFrame(rows, "temperature_K double, radiant_heat_MW double, source_area_m2 double, classification string, longitude double, latitude double")
    tables.write_kml(df.repartition(3), str(tmp_path / "kml"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "kml").glob("part-*")))
    root = ET.fromstring(text.encode())
    marks = root.findall(".//{http://www.opengis.net/kml/2.2}Placemark")
    assert len(marks) == 50 and "a<b>&c" in marks[0][1].text


def test_missing_csv_and_append(spark, tmp_path):
    path = str(tmp_path / "t")
    assert tables.read_csv(spark, path).count() == 0 and tables.read_csv(spark, path).columns == tables.SCHEMA.names
    first = tables.aligned(spark.createDataFrame([(1, 2.0)], "row int, temperature_K double"))
    tables.append_csv(first, path)
    late = spark.createDataFrame([(3.0, 7, True, 2)], "temperature_K double, n_bands_used int, detected_M12 boolean, row int")
    tables.append_csv(late, path)
    got = {r.row: (r.temperature_K, r.n_bands_used, r.detected_M12) for r in tables.read_csv(spark, path).collect()}
    assert got == {1: (2.0, None, None), 2: (3.0, 7, True)}


def test_parquet_overwrite_leaves_no_stale_dates(spark, tmp_path):
    path = str(tmp_path / "p")
    df = spark.createDataFrame([("2024-01-01 00:00:00", 1), ("2024-01-02 00:00:00", 2)], "t string, row int").select(F.col("t").cast("timestamp").alias("datetime_utc"), "row")
    tables.write_parquet(df, path)
    tables.write_parquet(df.filter("row = 2"), path)
    assert [r.row for r in spark.read.parquet(path).collect()] == [2]
    tables.write_parquet(df.filter("row = 2"), path, "append")
    assert spark.read.parquet(path).count() == 2


def test_site_key(spark):
    from emberscan.functions import columns as C

    df = spark.createDataFrame([(31.0, -103.0), (None, 1.0)], "a double, b double").select(C.site_key(F.col("a"), F.col("b")).alias("k"), C.site_text(F.col("a"), F.col("b")).alias("t"))
    got = df.collect()
    assert got[0].k.count(",") == 1 and got[0].t == "4133,-13733" and got[1].k is None
