"""Registry of this subpackage's queries, each with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from siftwell.llm import bpe, decontaminate, fingerprint, jaccard_join, ppm, quotes, sharding, token_files, toxicity, url_filter


def queries() -> dict:
    return {
        "op1_quote_linking": quotes.op1_quote_linking,
        "quoted_conversations": quotes.quoted_conversations,
        "op2_byte_bpe": bpe.op2_byte_bpe,
        "op3_decontaminate": decontaminate.op3_decontaminate,
        "op4_bounded_ring": sharding.op4_bounded_ring,
        "op5_improbable_features": fingerprint.op5_improbable_features,
        "op6_toxicity": toxicity.op6_toxicity,
        "op7_adaptive_prefix_join": jaccard_join.op7_adaptive_prefix_join,
        "op8_elias_fano_tokens": token_files.op8_elias_fano_tokens,
        "op9_url_filter": url_filter.op9_url_filter,
        "op10_ppm": ppm.op10_ppm,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_quote_linking": quotes.ORACLE_SQL, "quoted_conversations": quotes.QUOTED_SQL, "op9_url_filter": url_filter.ORACLE_SQL}
