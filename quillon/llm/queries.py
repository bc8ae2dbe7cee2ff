"""The queries of this subpackage and the SQL that gives the same rows."""

from __future__ import annotations

from quillon.llm import block_join, bpe, decontaminate, line_dedup, near_dedup, pii, quality, token_blocks, toxicity, url_filter

QUERIES = {
    "op1_url_markov_ratio": url_filter.op1,
    "op2_block_matrix_join": block_join.op2,
    "op3_prefix_decontamination": decontaminate.op3,
    "op4_disclosure_pii": pii.op4,
    "op5_bayesian_minhash": near_dedup.op5,
    "op6_quality_random_indexing": quality.op6,
    "op7_toxicity_counterfactual": toxicity.op7,
    "op8_bpe_segment_tree": bpe.op8,
    "op9_token_blocks": token_blocks.op9,
    "op10_line_winnowing": line_dedup.op10,
}
ORACLES = {
    "op2_block_matrix_join": block_join.ORACLE2,
    "op3_prefix_decontamination": decontaminate.ORACLE3,
    "op10_line_winnowing": line_dedup.ORACLE10,
}
