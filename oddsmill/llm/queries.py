"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from oddsmill.llm.chat import OP1_SQL, op1_chat_format
from oddsmill.llm.class_model import op3_class_model
from oddsmill.llm.decontaminate import op4_decontamination
from oddsmill.llm.hard_negatives import OP12_SQL, op12_hard_negatives
from oddsmill.llm.html_text import op10_html_text
from oddsmill.llm.jaccard_join import op7_jaccard_join
from oddsmill.llm.language import op2_language_id
from oddsmill.llm.minmax_dedup import op11_minmax_dedup
from oddsmill.llm.packing import op5_packing
from oddsmill.llm.prefix_trie import OP13_SQL, op13_prefix_trie
from oddsmill.llm.quality import op6_quality_rules
from oddsmill.llm.secrets import op8_secret_scans
from oddsmill.llm.token_file import op9_token_file

QUERIES = {
    "op1_chat_format": op1_chat_format,
    "op2_language_id": op2_language_id,
    "op3_class_model": op3_class_model,
    "op4_decontamination": op4_decontamination,
    "op5_packing": op5_packing,
    "op6_quality_rules": op6_quality_rules,
    "op7_jaccard_join": op7_jaccard_join,
    "op8_secret_scans": op8_secret_scans,
    "op9_token_file": op9_token_file,
    "op10_html_text": op10_html_text,
    "op11_minmax_dedup": op11_minmax_dedup,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_prefix_trie": op13_prefix_trie,
}

ORACLE_SQL: dict[str, str] = {"op1_chat_format": OP1_SQL, "op12_hard_negatives": OP12_SQL, "op13_prefix_trie": OP13_SQL}
