"""The queries of this subpackage, with SQL where it can express them."""

from __future__ import annotations

from tidemark.llm.language import op3_language_id
from tidemark.llm.line_dedup import OP7_SQL, op7_line_dedup
from tidemark.llm.mixing import OP1_SQL, op1_pfair_mix
from tidemark.llm.neighbours import op2_learned_partitions
from tidemark.llm.packing import op8_best_fit_packing
from tidemark.llm.pii import op10_bootstrapped_pii
from tidemark.llm.preferences import OP4_SQL, op4_preference_format
from tidemark.llm.quality import OP5_SQL, op5_quality_rules
from tidemark.llm.simhash import op6_simhash
from tidemark.llm.urls import OP9_SQL, op9_redirect_equivalence

QUERIES = {
    f.__name__: f
    for f in (op1_pfair_mix, op2_learned_partitions, op3_language_id, op4_preference_format, op5_quality_rules, op6_simhash, op7_line_dedup, op8_best_fit_packing, op9_redirect_equivalence, op10_bootstrapped_pii)
}
ORACLE: dict[str, str] = {"op1_pfair_mix": OP1_SQL, "op4_preference_format": OP4_SQL, "op5_quality_rules": OP5_SQL, "op7_line_dedup": OP7_SQL, "op9_redirect_equivalence": OP9_SQL}
