"""The queries of this subpackage, by name, and the SQL that gives the same rows where SQL can express them."""

from __future__ import annotations

from corpusmill.llm import chat_format, conversation_repair, fingerprint, language_id, line_dedup, merkle, mixing, packing, pii, sharding, simhash_dedup, topk, url_filter

QUERIES = {
    "op1_line_dedup": line_dedup.op1,
    "op2_sharding": sharding.op2,
    "op3_chat_format": chat_format.op3,
    "op4_mixing": mixing.op4,
    "op5_packing": packing.op5,
    "op6_language_id": language_id.op6,
    "op7_url_filter": url_filter.op7,
    "op8_simhash_dedup": simhash_dedup.op8,
    "op9_fingerprint": fingerprint.op9,
    "op10_topk_search": topk.op10,
    "op11_pii": pii.op11,
    "op12_conversation_repair": conversation_repair.op12,
    "op13_merkle_manifest": merkle.op13,
    "call_order": chat_format.call_order,
}

ORACLE_SQL: dict[str, str] = {
    "op1_line_dedup": line_dedup.ORACLE,
    "op2_sharding": sharding.ORACLE,
    "op3_chat_format": chat_format.ORACLE,
    "op7_url_filter": url_filter.ORACLE,
    "op10_topk_search": topk.ORACLE,
    "op12_conversation_repair": conversation_repair.ORACLE,
    "op13_merkle_manifest": merkle.ORACLE,
    "call_order": chat_format.CALL_ORDER,
}
