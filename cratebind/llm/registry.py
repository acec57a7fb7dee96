"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, chat, chunk_dedup, decontam, langid, lm, mixing, near_dedup, phrases, runs, secret_scan, topk, toxicity
from .common import table


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_toxicity": lambda s, d: toxicity.op1(table(s, d, "documents"), table(s, d, "labels")),
        "op2_lm_score": lambda s, d: lm.op2(table(s, d, "documents")),
        "op3_decontaminate": lambda s, d: decontam.op3(table(s, d, "documents"), table(s, d, "benchmark")),
        "op4_token_counts": lambda s, d: bpe.op4(table(s, d, "documents")),
        "op5_mixing": lambda s, d: mixing.op5(table(s, d, "documents")),
        "op6_secrets": lambda s, d: secret_scan.op6(table(s, d, "documents")),
        "op7_near_dedup": lambda s, d: near_dedup.op7(table(s, d, "documents")),
        "op8_topk": lambda s, d: topk.op8(table(s, d, "embeddings")),
        "op9_language": lambda s, d: langid.op9(table(s, d, "documents")),
        "op10_chat": lambda s, d: chat.op10(table(s, d, "conversations")),
        "op11_runs": lambda s, d: runs.op11(table(s, d, "documents")),
        "op12_phrases": lambda s, d: phrases.op12(table(s, d, "documents")),
        "op13_exact_dedup": lambda s, d: chunk_dedup.op13(table(s, d, "documents")),
    }


def oracle_sql() -> dict[str, str]:
    return {"op5_mixing": mixing.OP5_SQL, "op8_topk": topk.OP8_SQL, "op10_chat": chat.OP10_SQL, "op12_phrases": phrases.OP12_SQL, "op13_exact_dedup": chunk_dedup.OP13_SQL}
