"""The queries of these operators, and their SQL."""

from __future__ import annotations

import corpus_pipeline
from runloom.llm import chat, decontaminate, language, media, neardup, pages, pieces, repair, scoring, sharding, substring, url_filter, whitening


def queries() -> dict:
    return {
        "op1_sharding": sharding.op1_sharding,
        "op2_lm_scoring": scoring.op2_lm_scoring,
        "op3_language_id": language.op3_language_id,
        "op4_decontamination": decontaminate.op4_decontamination,
        "op5_url_filters": url_filter.op5_url_filters,
        "op6_minhash_near_dedup": neardup.op6_minhash_near_dedup,
        "op7_chat_formatting": chat.op7_chat_formatting,
        "op8_sentencepiece": pieces.op8_sentencepiece,
        "op9_substring_dedup": substring.op9_substring_dedup,
        "op10_media_columns": media.op10_media_columns,
        "op11_conversation_repair": repair.op11_conversation_repair,
        "op12_html_extraction": pages.op12_html_extraction,
        "op13_embedding_whitening": whitening.op13_embedding_whitening,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op4_decontamination": decontaminate.OP4_SQL,
        "op5_url_filters": url_filter.OP5_SQL,
        "op7_chat_formatting": chat.OP7_SQL,
        "op9_substring_dedup": substring.OP9_SQL,
        "op11_conversation_repair": repair.OP11_SQL,
        "op12_html_extraction": pages.OP12_SQL,
    }
