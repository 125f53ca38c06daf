"""The registered queries of the operators, and SQL for those that SQL can express."""

from __future__ import annotations

from .fingerprints import op8_fingerprints
from .mixing import op1_mixing
from .neighbours import op4_neighbours
from .packing import op6_packing
from .pseudolikelihood import op2_pseudo_likelihood
from .quality import op7_quality
from .simhash import op10_simhash
from .suffixes import op5_suffix_dedup
from .toxicity import op9_toxicity
from .urls import OP3_SQL, op3_url_filter


def queries() -> dict:
    return {
        "op1_mixing": op1_mixing,
        "op2_pseudo_likelihood": op2_pseudo_likelihood,
        "op3_url_filter": op3_url_filter,
        "op4_neighbours": op4_neighbours,
        "op5_suffix_dedup": op5_suffix_dedup,
        "op6_packing": op6_packing,
        "op7_quality": op7_quality,
        "op8_fingerprints": op8_fingerprints,
        "op9_toxicity": op9_toxicity,
        "op10_simhash": op10_simhash,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_url_filter": OP3_SQL}
