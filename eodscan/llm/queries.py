"""Registered queries of the subpackage, and their SQL where SQL can state them."""

from __future__ import annotations

from . import decontaminate, jaccard_join, language_id, license_scan, line_dedup, minhash_dedup, packing, phrase_mining, pii, suffix_dedup, toxicity, whitening, winnowing

QUERIES = {
    "op1_line_dedup": line_dedup.query,
    "op2_suffix_array_dedup": suffix_dedup.query,
    "op3_language_id": language_id.query,
    "op4_toxicity": toxicity.query,
    "op5_best_fit_packing": packing.query,
    "op6_license_scan": license_scan.query,
    "op7_decontamination": decontaminate.query,
    "op8_jaccard_join": jaccard_join.query,
    "op9_winnowing": winnowing.query,
    "op10_pii": pii.query,
    "op11_phrase_mining": phrase_mining.query,
    "op12_minhash_dedup": minhash_dedup.query,
    "op13_whitening": whitening.query,
}

SQL = {
    "op1_line_dedup": line_dedup.SQL,
    "op11_phrase_mining": phrase_mining.SQL,
}
