"""All registered queries and their checking SQL, by area."""

from __future__ import annotations

from tracelane.plans import q_logs, q_query, q_streams, q_text, q_time, q_tree

QUERIES: dict = {}
ORACLES: dict = {}

for module in (q_time, q_query, q_tree, q_text, q_logs, q_streams):
    for name, (query, sql) in module.REGISTERED.items():
        if name in QUERIES:
            raise ValueError(f"query registered twice: {name}")
        QUERIES[name] = query
        if sql is not None:
            ORACLES[name] = sql
