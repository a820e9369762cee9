"""The registered queries of this package and their SQL."""

from fieldlink.llm import (
    exact_dedup,
    hard_negatives,
    importance,
    license_scan,
    packing,
    pii,
    piecewise,
    quality,
    sharding,
    simhash,
    substring_dedup,
    subwords,
    url_filter,
)

QUERIES = {
    "op1_simhash": simhash.op1_simhash,
    "op2_sentencepiece": subwords.op2_sentencepiece,
    "op3_pii": pii.op3_pii,
    "op4_packing": packing.op4_packing,
    "op5_substring_dedup": substring_dedup.op5_substring_dedup,
    "op6_document_fingerprints": piecewise.op6_document_fingerprints,
    "op7_quality_classifier": quality.op7_quality_classifier,
    "op8_sharding": sharding.op8_sharding,
    "op9_exact_dedup": exact_dedup.op9_exact_dedup,
    "op10_license_scans": license_scan.op10_license_scans,
    "op11_importance_resampling": importance.op11_importance_resampling,
    "op12_hard_negatives": hard_negatives.op12_hard_negatives,
    "op13_url_filters": url_filter.op13_url_filters,
}

ORACLE_SQL = {
    "op9_exact_dedup": exact_dedup.OP9_SQL,
    "op12_hard_negatives": hard_negatives.OP12_SQL,
    "op13_url_filters": url_filter.OP13_SQL,
}
