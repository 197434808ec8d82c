"""Queries of the training-data operators and their SQL."""

from __future__ import annotations

from inkwell.llm import decontam, lm_scoring, mixing, quality, secrets, sharding, simhash, suffix_dedup, toxicity, urls


def queries() -> dict:
    return {
        "op1_mixing": mixing.contract,
        "op2_lm_scoring": lm_scoring.contract,
        "op3_suffix_dedup": suffix_dedup.contract,
        "op4_simhash_near_dedup": simhash.contract,
        "op5_toxicity": toxicity.contract,
        "op6_url_filters": urls.contract,
        "op7_quality_rules": quality.contract,
        "op8_secret_scans": secrets.contract,
        "op9_decontamination": decontam.contract,
        "op10_sharding": sharding.contract,
    }


def oracle_sql() -> dict[str, str]:
    """The other queries' models or hashes have no SQL form; tests hold them against brute force."""
    return {"op6_url_filters": urls.SQL, "op9_decontamination": decontam.SQL}
