"""Queries and DuckDB oracles of the corpus operators."""

from __future__ import annotations

from .decontamination import op7_decontamination
from .language_id import op5_language_id
from .line_dedup import OP9_SQL, op9_line_dedup
from .lm_scoring import op8_lm_scoring
from .media_columns import op3_media_columns
from .packing import op10_best_fit_packing
from .simhash import op2_simhash
from .substring_dedup import op4_substring_dedup
from .token_counts import op1_token_counts
from .toxicity import op6_toxicity

QUERIES = {
    "op1_token_counts": op1_token_counts,
    "op2_simhash": op2_simhash,
    "op3_media_columns": op3_media_columns,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_language_id": op5_language_id,
    "op6_toxicity": op6_toxicity,
    "op7_decontamination": op7_decontamination,
    "op8_lm_scoring": op8_lm_scoring,
    "op9_line_dedup": op9_line_dedup,
    "op10_best_fit_packing": op10_best_fit_packing,
}

ORACLES = {"op9_line_dedup": OP9_SQL}
