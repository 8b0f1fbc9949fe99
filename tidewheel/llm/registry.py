"""Queries of the training-data operators, and the SQL of those that SQL can express."""

from tidewheel.llm import exact_dedup, hard_negatives, licences, mixing, near_join, neighbours, packing, periodic, quality, secrets, substring_dedup, suffix_dedup, toxicity

QUERIES = {
    "op1_substring_dedup": substring_dedup.op1_substring_dedup,
    "op2_licences": licences.op2_licences,
    "op3_exact_dedup": exact_dedup.op3_exact_dedup,
    "op4_jaccard_join": near_join.op4_jaccard_join,
    "op5_mixing": mixing.op5_mixing,
    "op6_packing": packing.op6_packing,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_suffix_dedup": suffix_dedup.op8_suffix_dedup,
    "op9_nearest": neighbours.op9_nearest,
    "op10_secrets": secrets.op10_secrets,
    "op11_quality": quality.op11_quality,
    "op12_periodic_runs": periodic.op12_periodic_runs,
    "op13_hard_negatives": hard_negatives.op13_hard_negatives,
}

ORACLE_SQL = {
    "op3_exact_dedup": exact_dedup.OP3_SQL,
    "op13_hard_negatives": hard_negatives.OP13_SQL,
}
