"""The queries of this subpackage and, where SQL can express them, the SQL that checks them."""

from __future__ import annotations

from shelfline.llm import chat, decontamination, manifest, mixing, near_dedup, neighbours, packing, pii, quality, sharding, spelling, tokens, warc


def queries() -> dict:
    return {
        "op1_decontamination": decontamination.op1_decontamination,
        "op2_tokens": tokens.op2_tokens,
        "op3_warc": warc.op3_warc,
        "op4_near_dedup": near_dedup.op4_near_dedup,
        "op5_mixing": mixing.op5_mixing,
        "op6_sharding": sharding.op6_sharding,
        "op7_chat": chat.op7_chat,
        "op8_pii": pii.op8_pii,
        "op9_quality": quality.op9_quality,
        "op10_neighbours": neighbours.op10_neighbours,
        "op11_packing": packing.op11_packing,
        "op12_manifest": manifest.op12_manifest,
        "op13_spelling": spelling.op13_spelling,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_decontamination": decontamination.OP1_SQL,
        "op3_warc": warc.OP3_SQL,
        "op10_neighbours": neighbours.OP10_SQL,
        "op12_manifest": manifest.OP12_SQL,
        "op13_spelling": spelling.OP13_SQL,
    }
