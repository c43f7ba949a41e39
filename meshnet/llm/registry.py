"""The queries of this subpackage and their SQL, for the driver's entry module."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from meshnet.llm import (
    bpe_codec,
    conversation_repair,
    exact_dedup,
    exact_topk,
    language_id,
    license_scan,
    line_dedup,
    lm_scoring,
    near_dedup,
    packing,
    token_alignment,
    url_filter,
    warc,
)

_MODULES = {
    "op1_license_scan": license_scan,
    "op2_line_dedup": line_dedup,
    "op3_warc": warc,
    "op4_bpe": bpe_codec,
    "op5_exact_dedup": exact_dedup,
    "op6_url_filter": url_filter,
    "op7_exact_topk": exact_topk,
    "op8_language_id": language_id,
    "op9_packing": packing,
    "op10_near_dedup": near_dedup,
    "op11_conversation_repair": conversation_repair,
    "op12_lm_scoring": lm_scoring,
    "op13_token_alignment": token_alignment,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: module.query for name, module in _MODULES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: module.SQL for name, module in _MODULES.items() if module.SQL}
