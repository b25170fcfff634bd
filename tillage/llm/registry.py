"""The queries of this subpackage, and their SQL where SQL can express them."""

from tillage.llm import chat, fill_middle, language_id, line_dedup, near_dedup, packing, quality_classifier, quality_rules, secret_scan, sentencepiece, substring_dedup, topk, whitening

QUERIES = {
    "op1_top_k_search": topk.op1_top_k_search,
    "op2_best_fit_packing": packing.op2_best_fit_packing,
    "op3_quality_classifier": quality_classifier.op3_quality_classifier,
    "op4_line_dedup": line_dedup.op4_line_dedup,
    "op5_chat_formatting": chat.op5_chat_formatting,
    "op6_substring_dedup": substring_dedup.op6_substring_dedup,
    "op7_sentencepiece": sentencepiece.op7_sentencepiece,
    "op8_near_dedup": near_dedup.op8_near_dedup,
    "op9_quality_rules": quality_rules.op9_quality_rules,
    "op10_language_id": language_id.op10_language_id,
    "op11_embedding_whitening": whitening.op11_embedding_whitening,
    "op12_fill_in_middle": fill_middle.op12_fill_in_middle,
    "op13_secret_scan": secret_scan.op13_secret_scan,
}
ORACLE_SQL = {
    "op1_top_k_search": topk.ORACLE,
    "op4_line_dedup": line_dedup.ORACLE,
    "op5_chat_formatting": chat.ORACLE,
    "op6_substring_dedup": substring_dedup.ORACLE,
    "op8_near_dedup": near_dedup.ORACLE,
    "op9_quality_rules": quality_rules.ORACLE,
    "op12_fill_in_middle": fill_middle.ORACLE,
}
