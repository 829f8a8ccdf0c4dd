"""The queries of the corpus operators, and their SQL where SQL can express them."""

from __future__ import annotations

from annalum.llm import ball_kmeans, exact_dedup, fill_in_middle, hmm_lm, language_id, licenses, mixing, packing, quality_classifier, quality_rules, sharding, simhash, url_filters

QUERIES = {
    "op1_quality_rules": quality_rules.query,
    "op2_packing": packing.query,
    "op3_exact_dedup": exact_dedup.query,
    "op4_url_filters": url_filters.query,
    "op5_sharding": sharding.query,
    "op6_hmm_lm": hmm_lm.query,
    "op7_simhash": simhash.query,
    "op8_language_id": language_id.query,
    "op9_quality_classifier": quality_classifier.query,
    "op10_mixing": mixing.query,
    "op11_fill_in_middle": fill_in_middle.query,
    "op12_licenses": licenses.query,
    "op13_ball_kmeans": ball_kmeans.query,
}

ORACLE_SQL = {
    "op1_quality_rules": quality_rules.SQL,
    "op3_exact_dedup": exact_dedup.SQL,
    "op4_url_filters": url_filters.SQL,
    "op10_mixing": mixing.SQL,
    "op11_fill_in_middle": fill_in_middle.SQL,
    "op13_ball_kmeans": ball_kmeans.SQL,
}
