"""python -m emberscan --pixels PATH | --datadir PATH | --radiance PATH --geolocation PATH --output PATH
    [--bbox S N W E] [--format csv|parquet] [--describe]
python -m emberscan fetch --start DATE --end DATE --search-url URL --files-url URL --token-variable NAME
    --table PATH --log PATH --folder PATH [--bbox S N W E]
"""

from __future__ import annotations

import argparse
import datetime as dt
import sys
import uuid

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions import columns as C
from .functions import constants as K
from .functions.shared import shared_folder
from .operators import analytics
from .plans.detection import detections
from .sources import catalogue, granules, netcdf, tables
from .streaming import incremental


def _session() -> SparkSession:
    return SparkSession.builder.appName("emberscan").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def fetch(argv: list[str], connect=catalogue.Catalogue) -> int:
    """Search, download, process, log and delete; 1 if a granule failed."""
    p = argparse.ArgumentParser(prog="emberscan fetch")
    for name, text in (("start", "first date"), ("end", "last date")):
        p.add_argument(f"--{name}", required=True, type=dt.date.fromisoformat, help=text)
    p.add_argument("--search-url", required=True)
    p.add_argument("--files-url", required=True)
    p.add_argument("--token-variable", required=True, help="environment variable (or .env entry) that holds the token")
    p.add_argument("--table", required=True, help="where the detections are appended")
    p.add_argument("--log", required=True, help="log of processed granules")
    p.add_argument("--folder", required=True, help="folder for raw files that driver and executors share")
    p.add_argument("--bbox", nargs=4, type=float, default=K.CONUS, metavar=("SOUTH", "NORTH", "WEST", "EAST"))
    a = p.parse_args(argv)
    got = incremental.fetch_and_process(
        _session(), connect(a.search_url, a.files_url), a.start, a.end, a.table, a.log, a.folder, catalogue.token(a.token_variable), tuple(a.bbox),
        progress=lambda done, total, text: print(f"[{done}/{total}] {text}"),
    )
    print({k: v for k, v in got.items() if k != "failed"})
    for key, error in got["failed"].items():
        print(f"{key}: {error}", file=sys.stderr)
    return 1 if got["failed"] else 0


def main(argv: list[str] | None = None) -> int:
    argv = sys.argv[1:] if argv is None else argv
    if argv[:1] == ["fetch"]:
        return fetch(argv[1:])
    p = argparse.ArgumentParser(prog="emberscan", description="Detect night-time combustion sources.")
    p.add_argument("--pixels", help="pixel table (Parquet)")
    p.add_argument("--datadir", help="folder of granule files (needs netCDF4 or h5py)")
    p.add_argument("--radiance", help="one radiance file")
    p.add_argument("--geolocation", help="its geolocation file")
    p.add_argument("--bbox", nargs=4, type=float, default=K.CONUS, metavar=("SOUTH", "NORTH", "WEST", "EAST"))
    p.add_argument("--output", help="where the detections go")
    p.add_argument("--format", choices=("csv", "parquet"), default="csv")
    p.add_argument("--describe", action="store_true", help="print what the files hold (for --pixels: the schema) and stop")
    a = p.parse_args(argv)
    spark = _session()
    pairs = None
    if a.pixels:
        pixels = spark.read.parquet(a.pixels)
    elif a.datadir:
        files = granules.list_files(spark, a.datadir)
        name = F.substring_index("path", "/", -1)
        pairs = granules.pair_granules(files.filter(name.startswith(granules.RADIANCE)), files.filter(name.startswith(granules.GEOLOCATION)))
    elif a.radiance and a.geolocation:
        name = a.radiance.rsplit("/", 1)[-1]
        key = ".".join(name.split(".")[1:3]) or name
        pairs = spark.createDataFrame([(key, a.radiance, a.geolocation)], "granule_key string, rad_path string, geo_path string")
    else:
        p.error("one of --pixels, --datadir, or --radiance with --geolocation is needed")
    if a.describe:
        if pairs is None:
            pixels.printSchema()
        else:
            files = pairs.select(F.explode(F.array("rad_path", "geo_path")).alias("path"))
            netcdf.describe(files).orderBy("path", "group", "kind", "name").show(10_000, truncate=120)
        return 0
    failed = {}
    if pairs is not None:
        staging = f"{shared_folder(spark)}/pixels-{uuid.uuid4().hex}"
        netcdf.read_pixels(pairs).filter(incremental.region_or_error(tuple(a.bbox))).write.parquet(staging)
        pixels = spark.read.parquet(staging)
        bad = incremental.failures(pixels)
        failed = {r["granule_key"]: r["error"] for r in bad.collect()}  # a row per file that could not be read
        pixels = pixels.join(bad.select("granule_key"), "granule_key", "left_anti").drop("error")
    when = {"when": C.key_time(F.col("granule_key"))} if pairs is not None else {}
    found = detections(pixels, tuple(a.bbox), **when).cache()
    if a.output and not found.isEmpty():
        (tables.write_csv if a.format == "csv" else tables.write_parquet)(found, a.output)
    for key, error in failed.items():
        print(f"{key}: {error}", file=sys.stderr)
    analytics.flare_ranges(found).show()
    analytics.class_counts(found).show()
    return 1 if failed else 0


if __name__ == "__main__":
    raise SystemExit(main())
