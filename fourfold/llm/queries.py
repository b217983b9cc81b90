"""Queries of the operators, and SQL for those that SQL can express."""

from __future__ import annotations

from fourfold.llm import cotrain, decontaminate, exact_dedup, lattice_lm, licence, minhash, mixing, suffix_dedup, token_count, toxicity

QUERIES = {
    "op1_licence_scan": licence.op1_licence_scan,
    "op2_lattice_lm": lattice_lm.op2_lattice_lm,
    "op3_decontaminate": decontaminate.op3_decontaminate,
    "op4_suffix_dedup": suffix_dedup.op4_suffix_dedup,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_near_duplicates": minhash.op6_near_duplicates,
    "op7_exact_dedup": exact_dedup.op7_exact_dedup,
    "op8_quality": cotrain.op8_quality,
    "op9_token_counts": token_count.op9_token_counts,
    "op10_mix": mixing.op10_mix,
}

SQL = {
    "op7_exact_dedup": exact_dedup.OP7_SQL,
    "op10_mix": mixing.OP10_SQL,
}
