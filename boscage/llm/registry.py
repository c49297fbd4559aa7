"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import bpe, chat, exact, html, jaccard, lines, packing, quality, suffix, tokenfile

QUERIES = {
    "op1_packing": packing.op1_packing,
    "op2_suffix_dedup": suffix.op2_suffix_dedup,
    "op3_chat_format": chat.op3_chat_format,
    "op4_exact_dedup": exact.op4_exact_dedup,
    "op5_html_text": html.op5_html_text,
    "op6_byte_bpe": bpe.op6_byte_bpe,
    "op7_line_dedup": lines.op7_line_dedup,
    "op8_quality_rules": quality.op8_quality_rules,
    "op10_jaccard_join": jaccard.op10_jaccard_join,
    "op9_token_file": tokenfile.op9_token_file,
}
ORACLES = {"op3_chat_format": chat.ORACLE, "op4_exact_dedup": exact.ORACLE, "op10_jaccard_join": jaccard.ORACLE}
