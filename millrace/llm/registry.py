"""The queries of this subpackage by name, and SQL for those that SQL can express."""

from millrace.llm import chat_format, exact_dedup, hard_negatives, language_id, lexical_search, lm_scoring, matroska, mixing, near_dedup, quality, sentencepiece_codec, token_counts, url_lists

QUERIES = {
    "op1_near_dedup": near_dedup.op1_near_dedup,
    "op2_quality": quality.op2_quality,
    "op3_matroska": matroska.op3_matroska,
    "op4_url_lists": url_lists.op4_url_lists,
    "op5_chat_format": chat_format.op5_chat_format,
    "op6_token_counts": token_counts.op6_token_counts,
    "op7_exact_dedup": exact_dedup.op7_exact_dedup,
    "op8_sentencepiece": sentencepiece_codec.op8_sentencepiece,
    "op9_mixing": mixing.op9_mixing,
    "op10_language_id": language_id.op10_language_id,
    "op11_hard_negatives": hard_negatives.op11_hard_negatives,
    "op12_lm_scoring": lm_scoring.op12_lm_scoring,
    "op13_lexical_search": lexical_search.op13_lexical_search,
}

ORACLE_SQL: dict[str, str] = {
    "op1_near_dedup": near_dedup.OP1_SQL,
    "op4_url_lists": url_lists.OP4_SQL,
    "op5_chat_format": chat_format.OP5_SQL,
    "op7_exact_dedup": exact_dedup.OP7_SQL,
    "op11_hard_negatives": hard_negatives.OP11_SQL,
    "op13_lexical_search": lexical_search.OP13_SQL,
}
