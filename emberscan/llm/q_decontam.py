"""op3: which documents hold which benchmark items.

A pair (doc_id, item_id) repeats where rows of one id hold different texts.
"""

from .common import table
from .decontam import contaminated


def op3_decontaminate(spark, sf_dir):
    found = contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "covered", "n_words", "kind")
