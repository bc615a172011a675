"""The queries of this package and their SQL, for the entry point."""

from __future__ import annotations

from treeline.llm import bpe, chat, mixing, pivots, quality, simhash, substring, toxicity, urls, warc

QUERIES = {
    "op1_bpe": bpe.op1_bpe,
    "op2_warc": warc.op2_warc,
    "op3_url_filters": urls.op3_url_filters,
    "op4_substring": substring.op4_substring,
    "op5_mixing": mixing.op5_mixing,
    "op6_chat": chat.op6_chat,
    "op7_quality_rules": quality.op7_quality_rules,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_pivots": pivots.op9_pivots,
    "op10_simhash": simhash.op10_simhash,
}

ORACLES = {
    "op2_warc": warc.OP2_SQL,
    "op3_url_filters": urls.OP3_SQL,
    "op4_substring": substring.OP4_SQL,
    "op5_mixing": mixing.OP5_SQL,
    "op6_chat": chat.OP6_SQL,
    "op7_quality_rules": quality.OP7_SQL,
    "op9_pivots": pivots.OP9_SQL,
}
