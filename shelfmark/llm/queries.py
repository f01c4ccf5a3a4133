"""Queries of this subpackage by name, and SQL that gives the same rows."""

from __future__ import annotations

from .decontaminate import op9
from .fill_middle import REFERENCE as FILL_MIDDLE
from .fill_middle import op12
from .jaccard import op6
from .mixing import op7
from .negatives import REFERENCE as NEGATIVES
from .negatives import op11
from .outliers import op2
from .quality_trees import op8
from .records import op1
from .redirects import op3
from .repeats import op13
from .secrets import op5
from .sharding import op4
from .toxicity import op10

QUERIES = {
    "op1_record_files": op1,
    "op2_robust_outliers": op2,
    "op3_redirect_classes": op3,
    "op4_kd_tree_shards": op4,
    "op5_secret_forest": op5,
    "op6_jaccard_tree_join": op6,
    "op7_pivotal_mix": op7,
    "op8_quality_trees": op8,
    "op9_spaced_seed_decontamination": op9,
    "op10_toxicity_ftrl": op10,
    "op11_four_russians_negatives": op11,
    "op12_fill_in_middle": op12,
    "op13_repeated_substrings": op13,
}

REFERENCES: dict[str, str] = {
    "op11_four_russians_negatives": NEGATIVES,
    "op12_fill_in_middle": FILL_MIDDLE,
}
