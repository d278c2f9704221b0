"""Queries of this subpackage and the SQL that some of them have."""

from .decontamination import op9_string_tiling
from .grammar_store import op3_grammar_store
from .gru_lm import op6_gru_scores
from .html_text import op5_html_text
from .language_crf import op4_language_crf
from .near_copies import op7_setsketch_near
from .neighbours import op10_block_neighbours
from .packing import op8_genetic_packing
from .token_counts import op1_token_counts
from .warc import OP2_SQL, op2_warc_normalise

QUERIES = {
    "op1_token_counts": op1_token_counts,
    "op2_warc_normalise": op2_warc_normalise,
    "op3_grammar_store": op3_grammar_store,
    "op4_language_crf": op4_language_crf,
    "op5_html_text": op5_html_text,
    "op6_gru_scores": op6_gru_scores,
    "op7_setsketch_near": op7_setsketch_near,
    "op8_genetic_packing": op8_genetic_packing,
    "op9_string_tiling": op9_string_tiling,
    "op10_block_neighbours": op10_block_neighbours,
}

ORACLE_SQL: dict[str, str] = {"op2_warc_normalise": OP2_SQL}
