"""The registered queries of this subpackage, and the SQL of those that SQL can express."""

from plumbline.llm import chat_format, class_lm, decontaminate, hard_negatives, near_dedup, online_packing, packing, quality_classifier, quality_rules, suffix_dedup, token_counts, url_filter, whitening

QUERIES = {
    "op1_chat_format": chat_format.op1,
    "op2_suffix_dedup": suffix_dedup.op2,
    "op3_url_filter": url_filter.op3,
    "op4_quality_classifier": quality_classifier.op4,
    "op5_class_lm": class_lm.op5,
    "op6_decontaminate": decontaminate.op6,
    "op7_quality_rules": quality_rules.op7,
    "op8_token_counts": token_counts.op8,
    "op9_packing": packing.op9,
    "op10_near_dedup": near_dedup.op10,
    "op11_online_packing": online_packing.op11,
    "op12_hard_negatives": hard_negatives.op12,
    "op13_whitening": whitening.op13,
}
ORACLES = {
    "op1_chat_format": chat_format.OP1_SQL,
    "op2_suffix_dedup": suffix_dedup.OP2_SQL,
    "op6_decontaminate": decontaminate.OP6_SQL,
    "op7_quality_rules": quality_rules.OP7_SQL,
    "op10_near_dedup": near_dedup.OP10_SQL,
    "op12_hard_negatives": hard_negatives.OP12_SQL,
}
