"""Queries of this package by name, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillspark.llm import bpe, langid, mixing, mpeg, pii, simhash, suffix, token_counts, topk, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc": warc.op1_warc,
    "op2_simhash": simhash.op2_simhash,
    "op3_topk": topk.op3_topk,
    "op4_bpe": bpe.op4_bpe,
    "op5_language_id": langid.op5_language_id,
    "op6_mixing": mixing.op6_mixing,
    "op7_mpeg": mpeg.op7_mpeg,
    "op8_suffix_dedup": suffix.op8_suffix_dedup,
    "op10_pii": pii.op10_pii,
    "op9_token_counts": token_counts.op9_token_counts,
}
ORACLES: dict[str, str] = {
    "op3_topk": topk.ORACLE,
    "op6_mixing": mixing.ORACLE,
    "op8_suffix_dedup": suffix.ORACLE,
}
