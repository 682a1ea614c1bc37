"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import op1_jaccard_join, op2_chroma, op3_licenses, op4_toxicity, op5_main_text, op6_quality, op7_chat, op8_records, op9_sentencepiece, op10_decontaminate


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_jaccard_join": op1_jaccard_join.query,
        "op2_chroma": op2_chroma.query,
        "op3_licenses": op3_licenses.query,
        "op4_toxicity": op4_toxicity.query,
        "op5_main_text": op5_main_text.query,
        "op6_quality": op6_quality.query,
        "op7_chat": op7_chat.query,
        "op8_token_records": op8_records.query,
        "op9_sentencepiece": op9_sentencepiece.query,
        "op10_decontaminate": op10_decontaminate.query,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_licenses": op3_licenses.oracle()}
