"""The queries of this subpackage, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, html_text, language_id, mixing, near_dedup, pii, quality, secrets, token_counts, top_k

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": language_id.op1_language_id,
    "op2_exact_top_k": top_k.op2_exact_top_k,
    "op3_token_counts": token_counts.op3_token_counts,
    "op4_secret_scan": secrets.op4_secret_scan,
    "op5_near_dedup": near_dedup.op5_near_dedup,
    "op6_decontaminate": decontaminate.op6_decontaminate,
    "op7_html_text": html_text.op7_html_text,
    "op8_mixing": mixing.op8_mixing,
    "op9_pii": pii.op9_pii,
    "op10_quality": quality.op10_quality,
}

ORACLES: dict[str, str] = {
    "op2_exact_top_k": top_k.OP2_SQL,
    "op8_mixing": mixing.OP8_SQL,
}
