"""The queries of this subpackage, and their SQL."""

from __future__ import annotations

from reelframe.llm import block_max, byte_bpe, fill_in_middle, html_wrapper, license_scan, near_dedup, personal_data, prefix_fingerprint, source_mixing, suffix_dedup, toxicity, url_filter, vector_search

QUERIES = {
    "op1_segment_topk": vector_search.op1_segment_topk,
    "op2_url_models": url_filter.op2_url_models,
    "op3_minhash_dedup": near_dedup.op3_minhash_dedup,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_suffix_dedup": suffix_dedup.op5_suffix_dedup,
    "op6_weak_supervision": personal_data.op6_weak_supervision,
    "op7_hierarchical_mixing": source_mixing.op7_hierarchical_mixing,
    "op8_byte_bpe": byte_bpe.op8_byte_bpe,
    "op9_prefix_fingerprint": prefix_fingerprint.op9_prefix_fingerprint,
    "op10_patience_licenses": license_scan.op10_patience_licenses,
    "op11_block_max": block_max.op11_block_max,
    "op12_wrapper_induction": html_wrapper.op12_wrapper_induction,
    "op13_fill_in_middle": fill_in_middle.op13_fill_in_middle,
}
SQL = {
    "op1_segment_topk": vector_search.OP1_SQL,
    "op2_url_models": url_filter.OP2_SQL,
    "op7_hierarchical_mixing": source_mixing.OP7_SQL,
    "op11_block_max": block_max.OP11_SQL,
    "op13_fill_in_middle": fill_in_middle.OP13_SQL,
}
