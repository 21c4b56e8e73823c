"""The corpus queries and their DuckDB forms, for __spark_entry__."""

from __future__ import annotations

from . import fingerprint, language, licenses, mixing, mtree, neardup, packing, secrets, toxicity, warc

QUERIES = {
    "op1_mix_sources": mixing.op1_mix_sources,
    "op2_warc_derivatives": warc.op2_warc_derivatives,
    "op3_toxic_segments": toxicity.op3_toxic_segments,
    "op4_secret_scan": secrets.op4_secret_scan,
    "op5_probminhash_classes": neardup.op5_probminhash_classes,
    "op6_threshold_fingerprints": fingerprint.op6_threshold_fingerprints,
    "op7_language_mixture": language.op7_language_mixture,
    "op8_license_scan": licenses.op8_license_scan,
    "op9_best_fit_packing": packing.op9_best_fit_packing,
    "op10_mtree_top_k": mtree.op10_mtree_top_k,
}

ORACLE_SQL = {
    "op1_mix_sources": mixing.SQL,
    "op2_warc_derivatives": warc.SQL,
    "op10_mtree_top_k": mtree.SQL,
}
