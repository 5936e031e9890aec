"""The registered queries of this folder and the SQL that checks them."""

from __future__ import annotations

from tracelane.llm import chat, decontaminate, html, licences, neardup, packing, pii, quality, repair, secrets, toxicity, vectors, warc

QUERIES: dict = {}
ORACLES: dict = {}

for module in (pii, warc, chat, packing, licences, toxicity, html, neardup, decontaminate, quality, secrets, repair, vectors):
    for name, (query, sql) in module.REGISTERED.items():
        QUERIES[name] = query
        if sql is not None:
            ORACLES[name] = sql
