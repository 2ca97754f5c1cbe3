"""Queries of the training-data operators and the SQL that gives the same rows."""

from __future__ import annotations

from lodestrata.llm import chat_format, cws_fingerprint, fill_in_middle, ga_packing, lattice_lm, license_scan, minhash_dedup, projected_ann, quality_cnn, source_mix, token_alignment, token_scan, url_filter

QUERIES = {
    "op1_license_scan": license_scan.query,
    "op2_cws_fingerprint": cws_fingerprint.query,
    "op3_projected_ann": projected_ann.query,
    "op4_chat_format": chat_format.query,
    "op5_quality_cnn": quality_cnn.query,
    "op6_source_mix": source_mix.query,
    "op7_minhash_dedup": minhash_dedup.query,
    "op8_ga_packing": ga_packing.query,
    "op9_url_filter": url_filter.query,
    "op10_token_scan": token_scan.query,
    "op11_fill_in_middle": fill_in_middle.query,
    "op12_token_alignment": token_alignment.query,
    "op13_lattice_lm": lattice_lm.query,
}
ORACLES = {
    "op7_minhash_dedup": minhash_dedup.ORACLE_SQL,
    "op4_chat_format": chat_format.ORACLE_SQL,
    "op6_source_mix": source_mix.ORACLE_SQL,
    "op9_url_filter": url_filter.ORACLE_SQL,
    "op11_fill_in_middle": fill_in_middle.ORACLE_SQL,
}
