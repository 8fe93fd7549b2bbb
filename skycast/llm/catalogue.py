"""The queries of this subpackage and the SQL they must agree with."""

from __future__ import annotations

from . import bpe, knn, lines, merkle, packing, quality, resample, sharding, simhash, spotsigs, substrings, toxicity, warc

QUERIES = {
    "op1_best_fit_packing": packing.op1_best_fit_packing,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_voronoi_top_k": knn.op3_voronoi_top_k,
    "op4_quality_rules": quality.op4_quality_rules,
    "op5_simhash_groups": simhash.op5_simhash_groups,
    "op6_spotsigs": spotsigs.op6_spotsigs,
    "op7_byte_bpe": bpe.op7_byte_bpe,
    "op8_warc_derivatives": warc.op8_warc_derivatives,
    "op9_rendezvous_sharding": sharding.op9_rendezvous_sharding,
    "op10_fm_substrings": substrings.op10_fm_substrings,
    "op11_merkle_manifest": merkle.op11_merkle_manifest,
    "op12_line_dedup": lines.op12_line_dedup,
    "op13_importance_resampling": resample.op13_importance_resampling,
}
SQL: dict[str, str] = {
    "op3_voronoi_top_k": knn.SQL,
    "op11_merkle_manifest": merkle.SQL,
    "op12_line_dedup": lines.SQL,
    "op13_importance_resampling": resample.SQL,
}
