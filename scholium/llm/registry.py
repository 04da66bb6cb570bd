"""The corpus queries by name, and SQL for those that SQL expresses."""

from __future__ import annotations

from scholium.llm import (
    bpe, clustering, conversations, debruijn, decontaminate, html_text, licenses, minhash, pii, quality, simhash, suffix_dedup, tokens,
)

QUERIES = {
    "op1_pii": pii.query,
    "op2_suffix_dedup": suffix_dedup.query,
    "op3_html_text": html_text.query,
    "op4_decontaminate": decontaminate.query,
    "op5_license_scan": licenses.query,
    "op6_bpe": bpe.query,
    "op7_token_counts": tokens.query,
    "op8_simhash": simhash.query,
    "op9_substring_dedup": debruijn.query,
    "op10_quality_rules": quality.query,
    "op11_conversation_repair": conversations.query,
    "op12_centroid_clusters": clustering.query,
    "op13_minhash": minhash.query,
}

ORACLES = {
    "op2_suffix_dedup": suffix_dedup.ORACLE,
    "op9_substring_dedup": debruijn.ORACLE,
    "op10_quality_rules": quality.ORACLE,
    "op11_conversation_repair": conversations.ORACLE,
    "op12_centroid_clusters": clustering.ORACLE,
    "op13_minhash": minhash.ORACLE,
}
