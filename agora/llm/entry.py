"""Queries of the training-data operators, and SQL where SQL can express them."""

from __future__ import annotations

from .cobucket import op12_cobucket
from .decontam import op10_decontam
from .divergence import OP11_SQL, op11_divergence
from .hmm import op7_hmm
from .lexicon import op13_bpe
from .lines import OP2_SQL, op2_lines
from .neardup import op5_neardup
from .pieces import op3_pieces
from .quality import op8_quality
from .sharding import op9_sharding
from .suffixes import op6_suffixes
from .toxicity import op1_toxicity
from .urls import op4_urls

QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_lines": op2_lines,
    "op3_pieces": op3_pieces,
    "op5_neardup": op5_neardup,
    "op10_decontam": op10_decontam,
    "op4_urls": op4_urls,
    "op6_suffixes": op6_suffixes,
    "op7_hmm": op7_hmm,
    "op8_quality": op8_quality,
    "op9_sharding": op9_sharding,
    "op11_divergence": op11_divergence,
    "op12_cobucket": op12_cobucket,
    "op13_bpe": op13_bpe,
}
ORACLE_SQL = {"op2_lines": OP2_SQL, "op11_divergence": OP11_SQL}
