"""Queries of the training-data operators and, where SQL can state it, their SQL."""

from __future__ import annotations

from figureyard.llm import (
    dualtree, fingerprint, fmindex, language, minhash, mixing, packing, periodic, pii, quality, tokenstore, toxicity, urls,
)

QUERIES = {
    "op1_quality_rules": quality.query,
    "op2_minhash_near_dedup": minhash.query,
    "op3_url_model_ratio": urls.query,
    "op4_multiset_fingerprints": fingerprint.query,
    "op5_training_order": tokenstore.query,
    "op6_multi_length_packing": packing.query,
    "op7_pareto_mix": mixing.query,
    "op8_disclosing_terms": pii.query,
    "op9_toxic_passages": toxicity.query,
    "op10_byte_language": language.query,
    "op11_fm_index": fmindex.query,
    "op12_periodic_runs": periodic.query,
    "op13_dual_tree_search": dualtree.query,
}

SQL = {
    "op1_quality_rules": quality.SQL,
    "op2_minhash_near_dedup": minhash.SQL,
    "op3_url_model_ratio": urls.SQL,
    "op11_fm_index": fmindex.SQL,
    "op13_dual_tree_search": dualtree.SQL,
}
