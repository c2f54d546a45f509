"""The queries of this subpackage, and SQL where SQL can express them."""

from __future__ import annotations

from . import audit, chat, htmltext, langid, lexical, media, mixing, neardup, packing, privacy, shards, topk, urlfilter

QUERIES = {
    "op1_exact_topk": topk.query,
    "op2_packing": packing.query,
    "op3_url_filter": urlfilter.query,
    "op4_chat_formatting": chat.query,
    "op5_sharding": shards.query,
    "op6_html_extraction": htmltext.query,
    "op7_matroska": media.query,
    "op8_minhash_dedup": neardup.query,
    "op9_mixing": mixing.query,
    "op10_language_id": langid.query,
    "op11_lexical_search": lexical.query,
    "op12_pii": privacy.query,
    "op13_filter_audit": audit.query,
}

ORACLES = {
    "op1_exact_topk": topk.ORACLE,
    "op4_chat_formatting": chat.ORACLE,
    "op11_lexical_search": lexical.ORACLE,
    "op12_pii": privacy.ORACLE,
    "op13_filter_audit": audit.ORACLE,
}
