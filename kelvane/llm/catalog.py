"""Queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from . import decontamination, jaccard_join, language_id, line_dedup, packing, quality_model, quality_rules, resampling, sharding, spelling, suffix_dedup, url_filters, warc


def queries():
    return {
        "op1_line_dedup": line_dedup.query,
        "op2_url_filters": url_filters.query,
        "op3_best_fit_packing": packing.query,
        "op4_sharding": sharding.query,
        "op5_language_id": language_id.query,
        "op6_jaccard_join": jaccard_join.query,
        "op7_quality_rules": quality_rules.query,
        "op8_decontamination": decontamination.query,
        "op9_warc_fixity": warc.query,
        "op10_suffix_dedup": suffix_dedup.query,
        "op11_importance_resampling": resampling.query,
        "op12_spelling_variants": spelling.query,
        "op13_quality_classifier": quality_model.query,
        # Parts of two of them that SQL can tell.
        "quality_base_counts": quality_rules.base_query,
        "url_given_rules": url_filters.rules_query,
    }


def oracle_sql():
    return {
        "op1_line_dedup": line_dedup.ORACLE,
        "op6_jaccard_join": jaccard_join.ORACLE,
        "op8_decontamination": decontamination.ORACLE,
        "op9_warc_fixity": warc.ORACLE,
        "op10_suffix_dedup": suffix_dedup.ORACLE,
        "op11_importance_resampling": resampling.ORACLE,
        "op12_spelling_variants": spelling.ORACLE,
        "quality_base_counts": quality_rules.BASE_ORACLE,
        "url_given_rules": url_filters.RULES_ORACLE,
    }
