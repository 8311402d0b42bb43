"""The queries of the training-data operators, and their SQL where SQL can say what they return."""

from . import bpe, centroids, chat, chunk_bpe, exact_dedup, langid, lexical, packing, pii, quality, rules, simhash, substring

QUERIES = {
    "op1_chat_format": chat.query,
    "op2_pii": pii.query,
    "op3_language_id": langid.query,
    "op4_exact_dedup": exact_dedup.query,
    "op5_quality_classifier": quality.query,
    "op6_packing": packing.query,
    "op7_byte_bpe": bpe.query,
    "op8_repeated_substrings": substring.query,
    "op9_simhash": simhash.query,
    "op10_quality_rules": rules.query,
    "op11_chunk_bpe": chunk_bpe.query,
    "op12_lexical_search": lexical.query,
    "op13_centroids": centroids.query,
}

ORACLE_SQL = {
    "op4_exact_dedup": exact_dedup.SQL,
    "op10_quality_rules": rules.SQL,
    "op12_lexical_search": lexical.SQL,
    "op13_centroids": centroids.SQL,
}
