"""op6: a predicted language for every document."""

from pyspark.sql import functions as F

from .common import crc_of_id, table
from .langid import predict, train


def held_out():
    return F.pmod(crc_of_id(F.col("doc_id")), F.lit(4)) == 2


def op6_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = train(docs, ~held_out())
    return predict(docs, model, ["doc_id"]).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "accepted")
