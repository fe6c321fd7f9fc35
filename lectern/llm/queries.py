"""The queries of the training-data operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lectern.llm import best_fit, chat_format, decontam, embedding_dedup, katz_lm, lexical_search, pattern_packing, pii, product_codes, quality, secret_scan, simhash_dedup, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_embedding_dedup": embedding_dedup.op1,
        "op2_chat_format": chat_format.op2,
        "op3_katz_lm": katz_lm.op3,
        "op4_simhash_dedup": simhash_dedup.op4,
        "op5_secret_scan": secret_scan.op5,
        "op6_pattern_packing": pattern_packing.op6,
        "op7_warc": warc.op7,
        "op8_pii": pii.op8,
        "op9_decontam": decontam.op9,
        "op10_quality": quality.op10,
        "op11_lexical_search": lexical_search.op11,
        "op12_best_fit": best_fit.op12,
        "op13_product_codes": product_codes.op13,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_embedding_dedup": embedding_dedup.OP1_SQL, "op2_chat_format": chat_format.OP2_SQL, "op9_decontam": decontam.OP9_SQL, "op11_lexical_search": lexical_search.OP11_SQL, "op13_product_codes": product_codes.OP13_SQL}
