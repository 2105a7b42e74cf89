"""The queries of this package, one for each operator, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, jaccard, language, mixing, pieces, pivots, quality, sharding, token_counts, topk


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_embedding_dedup": pivots.op1_embedding_dedup,
        "op2_ngram_jaccard": jaccard.op2_ngram_jaccard,
        "op3_sentencepiece": pieces.op3_sentencepiece,
        "op4_token_counts": token_counts.op4_token_counts,
        "op5_topk": topk.op5_topk,
        "op6_language_id": language.op6_language_id,
        "op7_quality": quality.op7_quality,
        "op8_chat": chat.op8_chat,
        "op9_mixing": mixing.op9_mixing,
        "op10_sharding": sharding.op10_sharding,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_embedding_dedup": pivots.ORACLE_SQL,
        "op2_ngram_jaccard": jaccard.ORACLE_SQL,
        "op4_token_counts": token_counts.ORACLE_SQL,
        "op5_topk": topk.ORACLE_SQL,
        "op8_chat": chat.ORACLE_SQL,
        "op9_mixing": mixing.ORACLE_SQL,
        "op10_sharding": sharding.ORACLE_SQL,
    }
