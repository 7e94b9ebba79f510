"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from mulberry.llm.bpe import op3_bpe
from mulberry.llm.chat import OP10_SQL, op10_chat
from mulberry.llm.exact_dedup import OP8_SQL, op8_exact_dedup
from mulberry.llm.html_text import op2_html_text
from mulberry.llm.lexical import OP11_SQL, op11_lexical_search
from mulberry.llm.mixing import op5_mixing
from mulberry.llm.near_dedup import op6_near_dedup
from mulberry.llm.negatives import OP12_SQL, op12_hard_negatives
from mulberry.llm.quality import op9_quality
from mulberry.llm.substring_dedup import op4_substring_dedup
from mulberry.llm.topk import OP7_SQL, op7_topk
from mulberry.llm.toxicity import op1_toxicity
from mulberry.llm.vptree import op13_nearest

QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_html_text": op2_html_text,
    "op3_bpe": op3_bpe,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_mixing": op5_mixing,
    "op6_near_dedup": op6_near_dedup,
    "op7_topk": op7_topk,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_quality": op9_quality,
    "op10_chat": op10_chat,
    "op11_lexical_search": op11_lexical_search,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_nearest": op13_nearest,
}

ORACLES = {"op7_topk": OP7_SQL, "op8_exact_dedup": OP8_SQL, "op10_chat": OP10_SQL, "op11_lexical_search": OP11_SQL, "op12_hard_negatives": OP12_SQL}
