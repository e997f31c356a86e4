"""Queries of the text operators, and their SQL where SQL can express them."""

from __future__ import annotations

from shapeflow.llm.bin_search import op13_best_fit
from shapeflow.llm.exact_dedup import OP4_SQL, op4_exact_dedup
from shapeflow.llm.license_scan import OP1_SQL, op1_license_scan
from shapeflow.llm.line_dedup import op6_line_dedup
from shapeflow.llm.lm_scoring import op9_lm_scoring
from shapeflow.llm.merkle import OP11_SQL, op11_merkle_manifest
from shapeflow.llm.packing import op7_packing
from shapeflow.llm.quality import op10_quality_rules
from shapeflow.llm.simhash import op5_simhash
from shapeflow.llm.spelling import OP12_SQL, op12_spelling_variants
from shapeflow.llm.suffix_dedup import op3_suffix_dedup
from shapeflow.llm.tokenization import op8_bpe
from shapeflow.llm.toxicity import op2_toxicity

QUERIES = {
    "op1_license_scan": op1_license_scan,
    "op2_toxicity": op2_toxicity,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_simhash": op5_simhash,
    "op6_line_dedup": op6_line_dedup,
    "op7_packing": op7_packing,
    "op8_bpe": op8_bpe,
    "op9_lm_scoring": op9_lm_scoring,
    "op10_quality_rules": op10_quality_rules,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_best_fit": op13_best_fit,
}
ORACLES = {"op1_license_scan": OP1_SQL, "op4_exact_dedup": OP4_SQL, "op11_merkle_manifest": OP11_SQL, "op12_spelling_variants": OP12_SQL}
