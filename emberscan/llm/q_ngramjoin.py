"""op10: set size and component of every document."""

from .common import table
from .ngramjoin import link_components


def op10_ngram_jaccard(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return link_components(docs).select("doc_id", "n_shingles", "component_id")
