"""The corpus queries by name, and their SQL where SQL can express them."""

from __future__ import annotations

from . import op1_suffix, op2_pieces, op3_secrets, op4_html, op5_mixing, op6_classifier, op7_quality, op8_vectors, op9_ngrams, op10_lines

QUERIES = {
    "op1_suffix": op1_suffix.op1_suffix,
    "op2_pieces": op2_pieces.op2_pieces,
    "op3_secrets": op3_secrets.op3_secrets,
    "op4_html": op4_html.op4_html,
    "op5_mixing": op5_mixing.op5_mixing,
    "op6_classifier": op6_classifier.op6_classifier,
    "op7_quality": op7_quality.op7_quality,
    "op8_vectors": op8_vectors.op8_vectors,
    "op9_ngrams": op9_ngrams.op9_ngrams,
    "op10_lines": op10_lines.op10_lines,
}

ORACLE_SQL = {
    "op3_secrets": op3_secrets.oracle(),
    "op8_vectors": op8_vectors.ORACLE,
    "op9_ngrams": op9_ngrams.ORACLE,
    "op10_lines": op10_lines.ORACLE,
}
