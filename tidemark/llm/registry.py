"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from tidemark.llm.bpe import op4_byte_bpe
from tidemark.llm.hard_negatives import OP11_SQL, op11_hard_negatives
from tidemark.llm.importance import OP12_SQL, op12_importance
from tidemark.llm.line_dedup import OP1_SQL, op1_line_dedup
from tidemark.llm.mixing import op3_mixing
from tidemark.llm.near_dedup import OP5_SQL, op5_near_dedup
from tidemark.llm.neighbours import op2_neighbours
from tidemark.llm.quality_rank import op10_quality_rank
from tidemark.llm.quality_rules import op9_quality_rules
from tidemark.llm.sharding import op8_sharding
from tidemark.llm.substrings import OP13_SQL, op13_substring_dedup
from tidemark.llm.toxicity import op6_toxicity
from tidemark.llm.warc import OP7_SQL, op7_warc

QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_neighbours": op2_neighbours,
    "op3_mixing": op3_mixing,
    "op4_byte_bpe": op4_byte_bpe,
    "op5_near_dedup": op5_near_dedup,
    "op6_toxicity": op6_toxicity,
    "op7_warc": op7_warc,
    "op8_sharding": op8_sharding,
    "op9_quality_rules": op9_quality_rules,
    "op10_quality_rank": op10_quality_rank,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_importance": op12_importance,
    "op13_substring_dedup": op13_substring_dedup,
}

ORACLE_SQL: dict[str, str] = {"op1_line_dedup": OP1_SQL, "op5_near_dedup": OP5_SQL, "op7_warc": OP7_SQL, "op11_hard_negatives": OP11_SQL, "op12_importance": OP12_SQL, "op13_substring_dedup": OP13_SQL}
