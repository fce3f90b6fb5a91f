"""The folder that driver and executors share, lineage cut into it, and checked broadcasts."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a counted side of a join is broadcast (about 100 bytes each at most).
BROADCAST_ROWS = 200_000


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a temporary folder only in a local session without one, else ValueError."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named:
            if sc.master.split("[")[0] != "local":
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            named = tempfile.mkdtemp(prefix="shared")
        sc.setCheckpointDir(named)
    return sc.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """Write the rows to the shared folder and go on from there."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def small_side(df: DataFrame, rows: int | None = None, limit: int | None = None) -> DataFrame:
    """``df`` marked for broadcast if it has (or ``rows`` says) few rows; beyond, as it is."""
    n = df.count() if rows is None else rows
    return F.broadcast(df) if n <= (BROADCAST_ROWS if limit is None else limit) else df
