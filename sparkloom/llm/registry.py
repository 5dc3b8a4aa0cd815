"""The queries of this package and their SQL."""

from __future__ import annotations

from . import chat_format, decontaminate, jaccard_join, language_id, license_scan, line_crf, line_dedup, masked_lm, quality_rules, source_divergence, token_counts, tree_bpe, whitening


def queries() -> dict:
    return {
        "op1_quality_rules": quality_rules.op1_quality_rules,
        "op2_token_counts": token_counts.op2_token_counts,
        "op3_line_crf": line_crf.op3_line_crf,
        "op4_masked_lm": masked_lm.op4_masked_lm,
        "op5_tree_bpe": tree_bpe.op5_tree_bpe,
        "op6_decontaminate": decontaminate.op6_decontaminate,
        "op7_language_id": language_id.op7_language_id,
        "op8_line_dedup": line_dedup.op8_line_dedup,
        "op9_chat_format": chat_format.op9_chat_format,
        "op10_jaccard_join": jaccard_join.op10_jaccard_join,
        "op11_license_scan": license_scan.op11_license_scan,
        "op12_source_divergence": source_divergence.op12_source_divergence,
        "op13_embedding_whitening": whitening.op13_embedding_whitening,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_quality_rules": quality_rules.SQL, "op9_chat_format": chat_format.SQL, "op10_jaccard_join": jaccard_join.SQL,
        "op11_license_scan": license_scan.SQL, "op12_source_divergence": source_divergence.SQL,
    }
