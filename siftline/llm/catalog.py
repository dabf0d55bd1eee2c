"""The registered queries of the numbered operators, and SQL for those that SQL can express."""

from __future__ import annotations

from siftline.llm.block_max import OP11_SQL, op11_block_max
from siftline.llm.bloom_lm import op1_bloom_lm
from siftline.llm.cgk import op3_cgk_lsh
from siftline.llm.curve_packing import op12_curve_packing
from siftline.llm.debruijn import op2_debruijn
from siftline.llm.license_scan import op4_license_rules
from siftline.llm.lsh_forest import op6_lsh_forest
from siftline.llm.neighbour_quality import op7_neighbour_quality
from siftline.llm.packing import op5_best_fit_packing
from siftline.llm.periodic import op13_periodic_runs
from siftline.llm.pieces import op9_piece_viterbi
from siftline.llm.repetition import op10_suffix_repetition
from siftline.llm.suffix_dedup import op8_suffix_sort

QUERIES = {
    "op5_best_fit_packing": op5_best_fit_packing,
    "op9_piece_viterbi": op9_piece_viterbi,
    "op7_neighbour_quality": op7_neighbour_quality,
    "op4_license_rules": op4_license_rules,
    "op3_cgk_lsh": op3_cgk_lsh,
    "op2_debruijn": op2_debruijn,
    "op8_suffix_sort": op8_suffix_sort,
    "op6_lsh_forest": op6_lsh_forest,
    "op1_bloom_lm": op1_bloom_lm,
    "op10_suffix_repetition": op10_suffix_repetition,
    "op11_block_max": op11_block_max,
    "op12_curve_packing": op12_curve_packing,
    "op13_periodic_runs": op13_periodic_runs,
}
ORACLE: dict[str, str] = {"op11_block_max": OP11_SQL}
