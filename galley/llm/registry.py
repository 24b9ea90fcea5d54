"""The queries of this subpackage and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from galley.llm import chat, exact_dedup, fim, html_text, instructions, mixing, near_dedup, nearest, negatives, packing, quality, simhash, tokens, toxicity

QUERIES = {
    "op1_mix_sources": mixing.query,
    "op2_minhash_near_dedup": near_dedup.query,
    "op3_token_counts": tokens.query,
    "op4_toxicity": toxicity.query,
    "op5_nearest_neighbours": nearest.query,
    "op6_exact_dedup": exact_dedup.query,
    "op7_pack_sequences": packing.query,
    "op8_html_text": html_text.query,
    "op9_chat_format": chat.query,
    "op10_quality_rules": quality.query,
    "op11_simhash_near_dedup": simhash.query,
    "op12_fill_in_middle": fim.query,
    "op13_hard_negatives": negatives.query,
    "pack_instructions": instructions.query,
}

ORACLES = {
    "op1_mix_sources": mixing.SQL,
    "op2_minhash_near_dedup": near_dedup.SQL,
    "op6_exact_dedup": exact_dedup.SQL,
    "op12_fill_in_middle": fim.SQL,
    "op13_hard_negatives": negatives.SQL,
}
