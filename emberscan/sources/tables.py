"""Detection table on disk: schema, readers and writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import columns as C
from ..functions import constants as K

SCHEMA = T.StructType(
    [
        T.StructField("datetime_utc", T.TimestampType()),
        T.StructField("latitude", T.DoubleType()),
        T.StructField("longitude", T.DoubleType()),
        T.StructField("basin", T.StringType()),
        T.StructField("row", T.IntegerType()),
        T.StructField("col", T.IntegerType()),
        T.StructField("granule", T.StringType()),
        *[T.StructField(f"radiance_{b}", T.DoubleType()) for b in K.BANDS],
        *[T.StructField(c, T.DoubleType()) for c in ("temperature_K", "esf", "source_area_m2", "radiant_heat_MW", "fit_cost")],
        T.StructField("classification", T.StringType()),
        T.StructField("n_bands_used", T.IntegerType()),
        T.StructField("detected_M11", T.BooleanType()),
        T.StructField("detected_M12", T.BooleanType()),
    ]
)


def aligned(df: DataFrame, schema: T.StructType = SCHEMA) -> DataFrame:
    """``df`` with the table's columns in order, NULL where missing; other columns follow."""
    have = set(df.columns)
    cols = [F.col(f.name).cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType).alias(f.name) for f in schema]
    return df.select(*cols, *[c for c in df.columns if c not in schema.names])


def append_aligned(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of both; ``old``'s columns first, extra ones of ``new`` last, NULL where missing."""
    return old.unionByName(new, allowMissingColumns=True)


def read_csv(spark: SparkSession, path: str, schema: T.StructType = SCHEMA) -> DataFrame:
    """Detections from CSV with header: rows with too many fields go, short ones are padded; no rows without the path."""
    marked = T.StructType([*schema.fields, T.StructField("_broken", T.StringType())])
    try:
        df = spark.read.schema(marked).option("header", True).option("columnNameOfCorruptRecord", "_broken").option("enforceSchema", True).csv(path)
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)
    fields = F.size(F.split("_broken", ',(?=(?:[^"]*"[^"]*")*[^"]*$)', -1))
    df = df.filter(F.col("_broken").isNull() | (fields <= len(schema)))
    return df.select(*[C.clean(F.col(f.name)).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f.name) for f in schema])


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("header", True).option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss").csv(path)


def append_csv(df: DataFrame, path: str) -> None:
    """Append to a CSV table with header, or begin it: its columns in their order, NULL where ``df`` lacks one.

    Parts of a table share one header, so columns that are only in ``df`` come last,
    and rows written earlier are short by them, which ``read_csv`` pads.
    """
    spark = df.sparkSession
    try:
        have = spark.read.option("header", True).csv(path).columns
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        have = []
    old = [F.col(f"`{c}`") if c in df.columns else F.lit(None).cast("string").alias(c) for c in have]
    write_csv(df.select(*old, *[F.col(f"`{c}`") for c in df.columns if c not in have]), path, "append")


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Partitioned by date; ``overwrite`` replaces the whole table, ``append`` adds to it."""
    out = df.withColumn("date", F.to_date("datetime_utc"))
    out.write.mode(mode).option("partitionOverwriteMode", "static").partitionBy("date").parquet(path)


# KML colours (aabbggrr) by class: red, orange, and yellow for the others.
COLOURS = {"gas_flare": "ff0000ff", "biomass_burning": "ff00a5ff"}
OTHER_COLOUR = "ff00ffff"
KML_NAME = "Night-time combustion sources"


def _fixed(c: str, digits: int) -> Column:
    """A number with fixed digits, half to even; a missing one is written as nan."""
    # rounded before formatting, as the formatter rounds half up
    return F.coalesce(F.format_string(f"%.{digits}f", F.rint(F.col(c) * 10**digits) / 10**digits), F.lit("nan"))


def kml_rows(df: DataFrame) -> DataFrame:
    """(name, description, colour, longitude, latitude) of the fitted detections."""
    colour = F
    for k, v in COLOURS.items():
        colour = colour.when(F.col("classification") == k, v)
    return df.filter("temperature_K is not null").select(
        F.concat(_fixed("temperature_K", 0), F.lit("K, "), _fixed("radiant_heat_MW", 2), F.lit("MW")).alias("name"),
        F.concat(
            F.lit("Temperature: "), _fixed("temperature_K", 0), F.lit(" K\nRadiant Heat: "), _fixed("radiant_heat_MW", 2),
            F.lit(" MW\nSource Area: "), _fixed("source_area_m2", 1), F.lit(" m²\nClassification: "),
            F.coalesce("classification", F.lit("unknown")), F.lit("\n"),
        ).alias("description"),
        colour.otherwise(OTHER_COLOUR).alias("colour"), "longitude", "latitude",
    )


def kml_marks(df: DataFrame) -> DataFrame:
    """One KML placemark per row, as text."""
    esc = lambda c: F.replace(F.replace(F.col(c), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    return kml_rows(df).select(
        F.concat(
            F.lit("<Placemark><name>"), esc("name"), F.lit("</name><description>"), esc("description"),
            F.lit("</description><Style><IconStyle><color>"), F.col("colour"), F.lit("</color></IconStyle></Style><Point><coordinates>"),
            F.col("longitude").cast("string"), F.lit(","), F.col("latitude").cast("string"), F.lit(",0</coordinates></Point></Placemark>"),
        ).alias("value")
    )


def write_kml(df: DataFrame, path: str) -> None:
    """A KML document as numbered text parts: head, placemarks, foot; ``cat`` of the parts in order is valid XML.

    The head and the foot are partitions of their own around those of the
    placemarks, which stay as distributed as ``df``.
    """
    spark = df.sparkSession
    line = lambda text: spark.range(1, numPartitions=1).select(F.lit(text).alias("value"))
    head = (f'<?xml version="1.0" encoding="UTF-8"?>\n<kml xmlns="http://www.opengis.net/kml/2.2"><Document><name>{KML_NAME}</name>')
    line(head).unionByName(kml_marks(df)).unionByName(line("</Document></kml>")).write.mode("overwrite").text(path)
