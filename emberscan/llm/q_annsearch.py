"""op5: the five nearest vectors of every fiftieth vector."""

from pyspark.sql import functions as F

from .annsearch import nearest_neighbours
from .common import table


def op5_ann(spark, sf_dir):
    return nearest_neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)
