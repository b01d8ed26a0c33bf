"""Queries over the corpus tables, for the entry file."""

from __future__ import annotations

from .alignment import op12_alignment
from .bpe import op3_bpe
from .divergence import OP11_SQL, op11_divergence
from .html import op10_html
from .language import op1_language
from .licenses import op9_licenses
from .mixing import op2_mixing
from .quality import op4_quality
from .simhash import op8_simhash
from .spotsigs import op5_spotsigs
from .toxicity import op6_toxicity
from .warc import OP7_SQL, op7_warc
from .wordbpe import op13_words

QUERIES = {
    "op1_language": op1_language,
    "op2_mixing": op2_mixing,
    "op3_bpe": op3_bpe,
    "op4_quality": op4_quality,
    "op5_spotsigs": op5_spotsigs,
    "op6_toxicity": op6_toxicity,
    "op7_warc": op7_warc,
    "op8_simhash": op8_simhash,
    "op9_licenses": op9_licenses,
    "op10_html": op10_html,
    "op11_divergence": op11_divergence,
    "op12_alignment": op12_alignment,
    "op13_words": op13_words,
}
ORACLES: dict[str, str] = {
    "op7_warc": OP7_SQL,
    "op11_divergence": OP11_SQL,
}
