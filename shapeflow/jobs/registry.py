"""All queries over the library's own operators, with SQL for each that SQL can express."""

from __future__ import annotations

from shapeflow.jobs import answer_queries, packet_queries, record_queries, shape_queries

MODULES = (packet_queries, shape_queries, record_queries, answer_queries)
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
ORACLES = {k: q for m in MODULES for k, q in m.ORACLES.items()}
