"""The queries of this subpackage by name, with SQL that gives the same rows where SQL can."""

from __future__ import annotations

from voxgrid.llm import abuse, lookalike, packing, pairs, private, residue, stuffing, tokenizer, truncation

QUERIES = {
    "p1_found": pairs.p1_found, "p1_pairs": pairs.p1_pairs,
    "p3_found": residue.p3_found, "p3_evidence": residue.p3_evidence,
    "p4_found": lookalike.p4_found, "p4_forms": lookalike.p4_forms, "p4_classes": lookalike.p4_classes,
    "p5_found": truncation.p5_found, "p5_rates": truncation.p5_rates, "p5_limits": truncation.p5_limits, "p5_evidence": truncation.p5_evidence,
    "p6_found": private.p6_found, "p6_masked": private.p6_masked,
    "p7_found": abuse.p7_found, "p7_scores": abuse.p7_scores, "p7_rates": abuse.p7_rates,
    "p8_ids": tokenizer.p8_ids,
    "p9_containers": packing.p9_containers, "p9_usage": packing.p9_usage,
    "p10_found": stuffing.p10_found, "p10_scores": stuffing.p10_scores,
}
ORACLE = {**pairs.ORACLE}
