"""Registered queries of the training-data operators and their SQL where SQL can express them."""

from __future__ import annotations

from . import chat, decontaminate, lines, mixing, pii, quality, sharding, simhash, tokens, urls

QUERIES = {
    "op1_mix_sources": mixing.op1,
    "op2_simhash": simhash.op2,
    "op3_shards": sharding.op3,
    "op4_training_order": tokens.op4,
    "op5_quality_rules": quality.op5,
    "op6_line_dedup": lines.op6,
    "op7_decontaminate": decontaminate.op7,
    "op8_chat": chat.op8,
    "op9_url_filter": urls.op9,
    "op10_pii": pii.op10,
}

ORACLES = {
    "op1_mix_sources": mixing.OP1_SQL,
    "op5_quality_rules": quality.OP5_SQL,
    "op8_chat": chat.OP8_SQL,
    "op9_url_filter": urls.OP9_SQL,
}
