"""Corpus pipeline: five stages, each written as Parquet and read again.

Language identification, line deduplication, near-duplicate removal, benchmark
decontamination, packing.  Every stage takes (spark, docs, sf_dir) and works on
all that the stage before it kept.  Packing comes last and returns pieces; the
other stages return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from emberscan.llm.common import delete_path, shared_folder, table
from emberscan.llm.decontam import drop_contaminated
from emberscan.llm.langid import accepted_only
from emberscan.llm.linededup import dedup_lines
from emberscan.llm.ngramjoin import keep_one
from emberscan.llm.packing import packed_pieces
from emberscan.llm.q_langid import held_out

#: Near-duplicate removal: words per shingle, and percent of similarity.
NEAR_SHINGLE, NEAR_PERCENT = 5, 80


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known with enough certainty."""
    return accepted_only(docs, ~held_out())


def remove_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that an earlier document has."""
    return dedup_lines(docs)


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return keep_one(docs, NEAR_SHINGLE, NEAR_PERCENT)


def remove_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents, packed into sequences."""
    return packed_pieces(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", remove_repeated_lines),
    ("ngram_jaccard", remove_near_duplicates),
    ("decontaminate", remove_contaminated),
    ("pack", pack_documents),
]

#: Classifiers and packing have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; results between stages go to the shared folder.

    A stage's result goes as soon as the next one's is written.
    """
    base = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, before = table(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES):
        out = f"{base}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
        if before:
            delete_path(spark, before)
        before = out
    return docs
