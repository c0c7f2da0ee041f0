"""Queries of the text operators and their SQL, where SQL can express them."""

from . import dedup_exact, encoding, html, language, packing, rollup, sharding, simhash, sketch, suffix

QUERIES = {
    "op1_token_counts": rollup.op1_token_counts,
    "op2_bpe": encoding.op2_bpe,
    "op3_simhash": simhash.op3_simhash,
    "op4_packing": packing.op4_packing,
    "op5_fingerprints": sketch.op5_fingerprints,
    "op6_language_id": language.op6_language_id,
    "language_id_pages": language.language_id_pages,
    "op7_html": html.op7_html,
    "op8_suffix_dedup": suffix.op8_suffix_dedup,
    "op9_sharding": sharding.op9_sharding,
    "op10_exact_dedup": dedup_exact.op10_exact_dedup,
}

ORACLES = {
    "op7_html": html.ORACLE,
    "op8_suffix_dedup": suffix.ORACLE,
    "op9_sharding": sharding.ORACLE,
    "op10_exact_dedup": dedup_exact.ORACLE,
}
