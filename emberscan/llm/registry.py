"""Name -> query and name -> DuckDB SQL for the training-data operators."""

from __future__ import annotations

import corpus_pipeline

from . import q_annsearch, q_chat, q_decontam, q_langid, q_linededup, q_ngramjoin, q_packing, q_quality, q_toxicity, q_urlfilter


def queries() -> dict:
    return {
        "op1_quality": q_quality.op1_quality,
        "op2_toxicity": q_toxicity.op2_toxicity,
        "op3_decontaminate": q_decontam.op3_decontaminate,
        "op4_pack": q_packing.op4_pack,
        "op5_ann": q_annsearch.op5_ann,
        "op6_language_id": q_langid.op6_language_id,
        "op7_chat_format": q_chat.op7_chat_format,
        "op8_line_dedup": q_linededup.op8_line_dedup,
        "op9_url_filter": q_urlfilter.op9_url_filter,
        "op10_ngram_jaccard": q_ngramjoin.op10_ngram_jaccard,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict:
    return {
        "op7_chat_format": q_chat.SQL,
        "op8_line_dedup": q_linededup.SQL,
        "op9_url_filter": q_urlfilter.SQL,
    }
