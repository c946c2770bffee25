"""The subpackage's queries and their SQL, for __spark_entry__."""

from __future__ import annotations

from . import chat, exact_dedup, language_id, mixing, near_dedup, packing, pii, topk, toxicity, warc

QUERIES = {
    "op1_exact_dedup": exact_dedup.op1_exact_dedup,
    "op2_warc": warc.op2_warc,
    "op3_near_dedup": near_dedup.op3_near_dedup,
    "op4_pack": packing.op4_pack,
    "op5_chat": chat.op5_chat,
    "op6_mix_sources": mixing.op6_mix_sources,
    "op7_topk": topk.op7_topk,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_language_id": language_id.op9_language_id,
    "op10_personal_data": pii.op10_personal_data,
}
ORACLE_SQL = {
    "op1_exact_dedup": exact_dedup.ORACLE_SQL,
    "op2_warc": warc.ORACLE_SQL,
    "op5_chat": chat.ORACLE_SQL,
    "op7_topk": topk.ORACLE_SQL,
}
