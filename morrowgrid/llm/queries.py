"""The queries of this subpackage and their SQL, for the entry module."""

from __future__ import annotations

from . import bpe, decontamination, kdtree_kmeans, language_id, merge_replay, near_dup, pii, product_codes, sharding, substring_dedup, suffix_dedup, tiff, url_filter

QUERIES = {
    "op1_sampled_splitters": sharding.op1_sampled_splitters,
    "op2_tiff": tiff.op2_tiff,
    "op3_decontamination": decontamination.op3_decontamination,
    "op4_language_id": language_id.op4_language_id,
    "op5_url_filter": url_filter.op5_url_filter,
    "op6_near_dup": near_dup.op6_near_dup,
    "op7_bpe": bpe.op7_bpe,
    "op8_suffix_dedup": suffix_dedup.op8_suffix_dedup,
    "op9_pii": pii.op9_pii,
    "op10_substring_dedup": substring_dedup.op10_substring_dedup,
    "op11_merge_replay": merge_replay.op11_merge_replay,
    "op12_kdtree_kmeans": kdtree_kmeans.op12_kdtree_kmeans,
    "op13_product_codes": product_codes.op13_product_codes,
}
ORACLES = {
    "op5_url_filter": url_filter.ORACLE,
    "op12_kdtree_kmeans": kdtree_kmeans.ORACLE,
    "op13_product_codes": product_codes.ORACLE,
}
