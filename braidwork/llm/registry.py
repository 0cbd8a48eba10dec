"""The corpus operators' queries and SQL."""

from __future__ import annotations

from braidwork.llm import chosen_path, decontaminate, flac, ngram_lm, packing, pii, quality, suffix_dedup, template, token_ids


def queries() -> dict:
    found = (
        ngram_lm.op1_lm_scoring,
        pii.op2_pii,
        flac.op3_flac,
        template.op4_template,
        packing.op5_vector_packing,
        packing.packed_conversations,
        quality.op6_quality,
        token_ids.op7_bit_planes,
        decontaminate.op8_decontamination,
        chosen_path.op9_chosen_path,
        suffix_dedup.op10_suffix_dedup,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    """Of those that SQL can express on whole tables in bounded time."""
    return {"op9_chosen_path": chosen_path.ORACLE_SQL}
