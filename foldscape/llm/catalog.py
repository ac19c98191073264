"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from foldscape.llm import bpe, exact_dedup, jaccard_join, line_dedup, packing, quality, shards, suffix_dedup, toxicity, url_filter

QUERIES = {
    "op1_temporal_list": url_filter.op1_temporal_list,
    "op2_best_fit": packing.op2_best_fit,
    "op3_line_index": line_dedup.op3_line_index,
    "op4_llr_quality": quality.op4_llr_quality,
    "op5_voronoi_join": jaccard_join.op5_voronoi_join,
    "op6_recursive_bpe": bpe.op6_recursive_bpe,
    "op7_folded_lexicon": toxicity.op7_folded_lexicon,
    "op8_size_tiered": shards.op8_size_tiered,
    "op9_block_naming": exact_dedup.op9_block_naming,
    "op10_suffix_levels": suffix_dedup.op10_suffix_levels,
}

SQL = {
    "op10_suffix_levels": suffix_dedup.SQL,
    "op1_temporal_list": url_filter.SQL,
    "op3_line_index": line_dedup.SQL,
    "op5_voronoi_join": jaccard_join.SQL,
    "op9_block_naming": exact_dedup.SQL,
}
