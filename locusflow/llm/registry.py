"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from .ball_kmeans import OP11_SQL, op11_ball_kmeans
from .ball_tree import OP13_SQL, op13_ball_tree
from .bpe import op8_bpe
from .exact_dedup import OP1_SQL, op1_exact_dedup
from .jaccard_join import op2_jaccard_join
from .language_model import op9_lm_scoring
from .packing import op3_best_fit_packing
from .pii import op4_pii
from .quality import OP7_SQL, op7_quality_rules
from .ranked_search import OP12_SQL, op12_ranked_search
from .suffix_dedup import op5_suffix_dedup
from .token_files import op6_token_files
from .toxicity import op10_toxicity

QUERIES = {
    f.__name__: f
    for f in (
        op1_exact_dedup, op2_jaccard_join, op3_best_fit_packing, op4_pii, op5_suffix_dedup, op6_token_files, op7_quality_rules, op8_bpe, op9_lm_scoring, op10_toxicity,
        op11_ball_kmeans, op12_ranked_search, op13_ball_tree,
    )
}
SQL = {"op1_exact_dedup": OP1_SQL, "op7_quality_rules": OP7_SQL, "op11_ball_kmeans": OP11_SQL, "op12_ranked_search": OP12_SQL, "op13_ball_tree": OP13_SQL}
