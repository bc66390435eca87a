"""Registered queries of this subpackage and their SQL twins."""

from __future__ import annotations

from sessionlake.llm.ball_tree import OP12_SQL, op12_ranked_search
from sessionlake.llm.byte_bpe import op3_byte_bpe
from sessionlake.llm.decontaminate import OP1_SQL, op1_decontaminate
from sessionlake.llm.importance import OP13_SQL, op13_importance
from sessionlake.llm.language import op6_language
from sessionlake.llm.line_dedup import op4_line_dedup
from sessionlake.llm.log_bilinear import op11_log_bilinear
from sessionlake.llm.near_dedup import op8_near_dedup
from sessionlake.llm.secrets import op7_secrets
from sessionlake.llm.sharding import op2_sharding
from sessionlake.llm.token_count import op10_token_count
from sessionlake.llm.token_file import op5_token_file
from sessionlake.llm.vector_dedup import OP9_SQL, op9_vector_dedup

QUERIES = {
    "op1_decontaminate": op1_decontaminate,
    "op2_sharding": op2_sharding,
    "op3_byte_bpe": op3_byte_bpe,
    "op4_line_dedup": op4_line_dedup,
    "op5_token_file": op5_token_file,
    "op6_language": op6_language,
    "op7_secrets": op7_secrets,
    "op8_near_dedup": op8_near_dedup,
    "op9_vector_dedup": op9_vector_dedup,
    "op10_token_count": op10_token_count,
    "op11_log_bilinear": op11_log_bilinear,
    "op12_ranked_search": op12_ranked_search,
    "op13_importance": op13_importance,
}

ORACLES = {
    "op1_decontaminate": OP1_SQL,
    "op9_vector_dedup": OP9_SQL,
    "op12_ranked_search": OP12_SQL,
    "op13_importance": OP13_SQL,
}
