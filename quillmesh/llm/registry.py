"""The queries and SQL of the operators for training data."""

from __future__ import annotations

from quillmesh.llm import corpus_encoding, name_variants, personal_data, scan_repair, sentence_starts, similar_clusters, source_mixture, template_residue, term_frequency

MODULES = (term_frequency, sentence_starts, similar_clusters, corpus_encoding, source_mixture, name_variants, template_residue, scan_repair, personal_data)
QUERIES = {name: query for m in MODULES for name, query in m.QUERIES.items()}
ORACLES = {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
