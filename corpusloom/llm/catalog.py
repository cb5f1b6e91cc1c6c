"""Queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from . import bpe, centroids, chat, decontaminate, passages, quality, repair, secrets, sharding, simhash, suffix, toxicity, warc

MODULES = {
    "op1_simhash_near_dedup": simhash,
    "op2_byte_bpe": bpe,
    "op3_decontamination": decontaminate,
    "op4_secret_scans": secrets,
    "op5_toxicity": toxicity,
    "op6_sharding": sharding,
    "op7_suffix_array_dedup": suffix,
    "op8_warc": warc,
    "op9_substring_dedup": passages,
    "op10_quality_rules": quality,
    "op11_centroid_clustering": centroids,
    "op12_chat_formatting": chat,
    "op13_conversation_repair": repair,
}


def queries() -> dict:
    return {name: module.query for name, module in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: module.SQL for name, module in MODULES.items() if getattr(module, "SQL", None)}
