"""The registered queries of this subpackage."""

from __future__ import annotations

from . import brown_lm, exact_dedup, langid, ngram_join, packing, pieces, quality, substring_dedup, token_orc, warc

QUERIES = {
    "op1_warc": warc.query,
    "op2_token_orc": token_orc.query,
    "op3_substring_dedup": substring_dedup.query,
    "op4_ngram_join": ngram_join.query,
    "op5_langid": langid.query,
    "op6_brown_lm": brown_lm.query,
    "op7_pieces": pieces.query,
    "op8_quality": quality.query,
    "op9_exact_dedup": exact_dedup.query,
    "op10_packing": packing.query,
}

ORACLES: dict[str, str] = {"op1_warc": warc.ORACLE, "op9_exact_dedup": exact_dedup.ORACLE}
