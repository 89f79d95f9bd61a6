"""Registered queries of the training-data operators, with SQL where SQL can express them."""

from __future__ import annotations

from . import decontam, html, lines, mixing, neardup, negatives, pii, quality, shards, tokenfiles, topk, toxicity, trie

QUERIES = {
    "op1_personal_data": pii.op1_personal_data,
    "op2_decontaminate": decontam.op2_decontaminate,
    "op3_near_duplicates": neardup.op3_near_duplicates,
    "op4_mix_sources": mixing.op4_mix_sources,
    "op5_quality": quality.op5_quality,
    "op6_shard_documents": shards.op6_shard_documents,
    "op7_exact_top_k": topk.op7_exact_top_k,
    "op8_line_dedup": lines.op8_line_dedup,
    "op9_extract_html": html.op9_extract_html,
    "op10_toxicity": toxicity.op10_toxicity,
    "op11_token_files": tokenfiles.op11_token_files,
    "op12_hard_negatives": negatives.op12_hard_negatives,
    "op13_prefix_trie": trie.op13_prefix_trie,
}

ORACLES = {
    "op2_decontaminate": decontam.OP2_SQL,
    "op4_mix_sources": mixing.OP4_SQL,
    "op7_exact_top_k": topk.OP7_SQL,
    "op8_line_dedup": lines.OP8_SQL,
    "op12_hard_negatives": negatives.OP12_SQL,
    "op13_prefix_trie": trie.OP13_SQL,
}
