"""The registered queries of this subpackage and their SQL twins."""

from __future__ import annotations

from textlens.llm import (byte_dedup, decontaminate, lines, lm, mixing, prefix_trie, quality, repair, sharding, simhash,
                          substrings, tokens, toxicity)

QUERIES = {
    "op1_sharding": sharding.op1_sharding,
    "op2_line_dedup": lines.op2_line_dedup,
    "op3_decontamination": decontaminate.op3_decontamination,
    "op4_simhash": simhash.op4_simhash,
    "op5_substring_dedup": substrings.op5_substring_dedup,
    "op6_token_counts": tokens.op6_token_counts,
    "op7_mixing": mixing.op7_mixing,
    "op8_suffix_array_dedup": byte_dedup.op8_suffix_array_dedup,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_quality_rules": quality.op10_quality_rules,
    "op11_conversation_trie": prefix_trie.op11_conversation_trie,
    "op12_structure_repair": repair.op12_structure_repair,
    "op13_lm_scores": lm.op13_lm_scores,
}

ORACLE_SQL = {
    "op1_sharding": sharding.OP1_SQL,
    "op2_line_dedup": lines.OP2_SQL,
    "op3_decontamination": decontaminate.OP3_SQL,
    "op5_substring_dedup": substrings.OP5_SQL,
    "op7_mixing": mixing.OP7_SQL,
    "op8_suffix_array_dedup": byte_dedup.OP8_SQL,
    "op10_quality_rules": quality.OP10_SQL,
    "op11_conversation_trie": prefix_trie.OP11_SQL,
    "op12_structure_repair": repair.OP12_SQL,
}
