"""op1: a quality score for every document."""

from pyspark.sql import functions as F

from .common import crc_of_id, table
from .quality import score, train


def op1_quality(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held = F.pmod(crc_of_id(F.col("doc_id")), F.lit(3)) == 1
    forest = train(docs, labels, "quality", ~held)
    return score(docs, forest).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
