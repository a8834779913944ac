"""Queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from quern.llm import ann, jaccard_join, language_id, lattice_dedup, line_dedup, lm_scoring, mixing, packing, quality, sharding

QUERIES = {
    f.__name__: f
    for f in (
        quality.op1_quality, jaccard_join.op2_jaccard_join, ann.op3_ann, mixing.op4_mixing, lm_scoring.op5_lm_scoring, packing.op6_packing,
        sharding.op7_sharding, lattice_dedup.op8_lattice_dedup, line_dedup.op9_line_dedup, language_id.op10_language_id,
    )
}
ORACLES = {"op2_jaccard_join": jaccard_join.ORACLE, "op4_mixing": mixing.ORACLE, "op8_lattice_dedup": lattice_dedup.ORACLE, "op9_line_dedup": line_dedup.ORACLE}
