"""The registered queries of the corpus operators, and their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from triagemill.llm import conversation_trie, jaccard_join, language_id, line_dedup, merkle, mixing, packing, pii, quality, sharding, substring_dedup, suffix_dedup, topk

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii": pii.op1_pii,
    "op2_line_dedup": line_dedup.op2_line_dedup,
    "op3_language_id": language_id.op3_language_id,
    "op4_sharding": sharding.op4_sharding,
    "op5_mixing": mixing.op5_mixing,
    "op6_topk": topk.op6_topk,
    "op7_substring_dedup": substring_dedup.op7_substring_dedup,
    "op8_jaccard_join": jaccard_join.op8_jaccard_join,
    "op9_packing": packing.op9_packing,
    "op10_quality": quality.op10_quality,
    "op11_suffix_dedup": suffix_dedup.op11_suffix_dedup,
    "op12_merkle": merkle.op12_merkle,
    "op13_conversation_trie": conversation_trie.op13_conversation_trie,
}

ORACLE_SQL: dict[str, str] = {
    "op2_line_dedup": line_dedup.OP2_SQL,
    "op4_sharding": sharding.op4_sql(),
    "op5_mixing": mixing.OP5_SQL,
    "op6_topk": topk.OP6_SQL,
    "op7_substring_dedup": substring_dedup.OP7_SQL,
    "op10_quality": quality.OP10_SQL,
    "op11_suffix_dedup": suffix_dedup.OP11_SQL,
    "op12_merkle": merkle.OP12_SQL,
    "op13_conversation_trie": conversation_trie.OP13_SQL,
}
