"""Queries of the training-data operators, and their SQL."""

from __future__ import annotations

from . import oracle
from .exactdedup import op6_exact_dedup
from .hosts import op9_host_reputation
from .infill import op12_fill_in_middle
from .langid import op3_language_id
from .linededup import op4_line_dedup
from .lmscore import op2_context_mixing
from .mixing import op7_entropy_mix
from .packing import op5_best_fit_packing
from .phrases import op11_positional_index
from .quality import op1_quality_divergence
from .ranked import op13_ranked_search
from .setjoin import op10_ngram_jaccard
from .tokens import op8_token_counts

QUERIES = {
    f.__name__: f
    for f in (
        op1_quality_divergence,
        op2_context_mixing,
        op3_language_id,
        op4_line_dedup,
        op5_best_fit_packing,
        op6_exact_dedup,
        op7_entropy_mix,
        op8_token_counts,
        op9_host_reputation,
        op10_ngram_jaccard,
        op11_positional_index,
        op12_fill_in_middle,
        op13_ranked_search,
    )
}
ORACLE_SQL = oracle.SQL
