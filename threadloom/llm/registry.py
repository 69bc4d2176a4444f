"""The queries of this package and the SQL that checks them, where SQL can say it."""

from __future__ import annotations

from . import (
    conversation_repair,
    exact_dedup,
    importance,
    language_id,
    mixing,
    packing,
    pseudonyms,
    quality_rules,
    quality_trees,
    sentencepiece_codec,
    simhash,
    token_counts,
    toxicity,
)


def queries() -> dict:
    return {
        "op1_sentencepiece_codec": sentencepiece_codec.query,
        "op2_quality_rules": quality_rules.query,
        "op3_source_mixing": mixing.query,
        "op4_exact_dedup": exact_dedup.query,
        "op5_language_id": language_id.query,
        "op6_toxicity": toxicity.query,
        "op7_simhash_near_dedup": simhash.query,
        "op8_pii_pseudonyms": pseudonyms.query,
        "op9_token_counts": token_counts.query,
        "op10_quality_trees": quality_trees.query,
        "op11_importance_resampling": importance.query,
        "op12_conversation_repair": conversation_repair.query,
        "op13_packing": packing.query,
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_exact_dedup": exact_dedup.ORACLE_SQL, "op12_conversation_repair": conversation_repair.ORACLE_SQL}
