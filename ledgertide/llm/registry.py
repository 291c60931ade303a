"""The operators' queries and the SQL of those that SQL can express."""

from __future__ import annotations

import corpus_pipeline
from ledgertide.catalog import Query
from ledgertide.llm import clustering, conversations, exact_dedup, language_id, mixing, ngram_join, packing, quality_rules, secret_scan, simhash, substring_dedup, token_store, toxicity


def queries() -> dict[str, Query]:
    return {
        "op1_toxicity": toxicity.op1_toxicity,
        "op2_cost_packing": packing.op2_cost_packing,
        "op3_exact_dedup": exact_dedup.op3_exact_dedup,
        "op4_language_id": language_id.op4_language_id,
        "op5_mixing": mixing.op5_mixing,
        "op6_secret_scan": secret_scan.op6_secret_scan,
        "op7_simhash": simhash.op7_simhash,
        "op8_token_store": token_store.op8_token_store,
        "op9_substring_dedup": substring_dedup.op9_substring_dedup,
        "op10_quality_rules": quality_rules.op10_quality_rules,
        "op11_centroid_clustering": clustering.op11_centroid_clustering,
        "op12_ngram_join": ngram_join.op12_ngram_join,
        "op13_conversation_repair": conversations.op13_conversation_repair,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_exact_dedup": exact_dedup.OP3_SQL, "op10_quality_rules": quality_rules.OP10_SQL, "op11_centroid_clustering": clustering.OP11_SQL}
