"""Queries of the training-data operators and their SQL."""

from __future__ import annotations

from scorewatch.llm import (exact_dedup, hmm, jaccard, line_dedup, merkle, packing, pieces, quality, resample,
                            simhash, topk, url_filter, warc)

QUERIES = {
    "op1_packing": packing.op1_packing,
    "op2_warc": warc.op2_warc,
    "op3_exact_dedup": exact_dedup.op3_exact_dedup,
    "op4_quality_trees": quality.op4_quality_trees,
    "op5_simhash_golay": simhash.op5_simhash_golay,
    "op6_sentencepiece": pieces.op6_sentencepiece,
    "op7_url_filter": url_filter.op7_url_filter,
    "op8_ball_tree_topk": topk.op8_ball_tree_topk,
    "op9_hmm_scores": hmm.op9_hmm_scores,
    "op10_line_dedup": line_dedup.op10_line_dedup,
    "op11_ngram_jaccard": jaccard.op11_ngram_jaccard,
    "op12_importance_resampling": resample.op12_importance_resampling,
    "op13_merkle_manifest": merkle.op13_merkle_manifest,
}

SQL = {
    "op2_warc": warc.SQL,
    "op3_exact_dedup": exact_dedup.SQL,
    "op7_url_filter": url_filter.SQL,
    "op8_ball_tree_topk": topk.SQL,
    "op10_line_dedup": line_dedup.SQL,
    "op12_importance_resampling": resample.SQL,
    "op13_merkle_manifest": merkle.SQL,
}
