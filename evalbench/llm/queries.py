"""The pipeline operators' queries: opN_<name> -> callable, and SQL where SQL can express one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from evalbench.llm import bpe, conversations, divergence, html, lm, media, mixing, neardup, passages, quality, secrets, sharding, topk


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_segment_topk": topk.op1,
        "op2_secret_cnn": secrets.op2,
        "op3_html_tree": html.op3,
        "op4_mixing_tree": mixing.op4,
        "op5_bpe_trie": bpe.op5,
        "op6_ef_trie_lm": lm.op6,
        "op7_compact_windows": passages.op7,
        "op8_icws_neardup": neardup.op8,
        "op9_jpeg_media": media.op9,
        "op10_knn_quality": quality.op10,
        "op11_joint_divergence": divergence.op11,
        "op12_bounded_ring": sharding.op12,
        "op13_viterbi_repair": conversations.op13,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_segment_topk": topk.SQL, "op11_joint_divergence": divergence.SQL, "op13_viterbi_repair": conversations.SQL}
