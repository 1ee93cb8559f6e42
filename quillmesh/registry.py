"""The queries and SQL of the core's operators."""

from __future__ import annotations

from quillmesh.plans import graph_queries, more_queries, text_queries, vector_queries

FLAGSHIP = "stance_by_speaker"
MODULES = (text_queries, vector_queries, graph_queries, more_queries)
QUERIES = {name: query for m in MODULES for name, query in m.QUERIES.items()}
ORACLES = {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
