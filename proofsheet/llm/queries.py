"""Queries of the corpus operators, each over its whole table, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat_format, language_id, lm_score, media, mixing, ngram_join, packing, quality_rules, secret_scan, url_filter


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality_rules": quality_rules.op1_quality_rules,
        "op2_language_id": language_id.op2_language_id,
        "op3_secret_scan": secret_scan.op3_secret_scan,
        "op4_packing": packing.op4_packing,
        "op5_ngram_join": ngram_join.op5_ngram_join,
        "op6_media_columns": media.op6_media_columns,
        "op7_mixing": mixing.op7_mixing,
        "op8_chat_rotation": chat_format.op8_chat_rotation,
        "op9_lm_score": lm_score.op9_lm_score,
        "op10_url_filter": url_filter.op10_url_filter,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_quality_rules": quality_rules.ORACLE,
        "op7_mixing": mixing.ORACLE,
        "op8_chat_rotation": chat_format.ORACLE,
        "op10_url_filter": url_filter.ORACLE,
    }
