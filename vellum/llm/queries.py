"""The queries of the training-data operators and their SQL."""

from __future__ import annotations

from . import decision_list, language_profiles, licences, mixing, oph, piece_matching, quality_compression, sharding, simhash, simhash_sql, url_reputation


def queries() -> dict:
    return {
        "op1_simhash_near_dedup": simhash.op1_simhash_near_dedup,
        "op2_url_filters": url_reputation.op2_url_filters,
        "op3_quality_classifier": quality_compression.op3_quality_classifier,
        "op4_quality_rules": decision_list.op4_quality_rules,
        "op5_language_id": language_profiles.op5_language_id,
        "op6_sentencepiece": piece_matching.op6_sentencepiece,
        "op7_licence_scans": licences.op7_licence_scans,
        "op8_mixing": mixing.op8_mixing,
        "op9_sharding": sharding.op9_sharding,
        "op10_fingerprints": oph.op10_fingerprints,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_simhash_near_dedup": simhash_sql.ORACLE, "op2_url_filters": url_reputation.ORACLE, "op9_sharding": sharding.ORACLE}
