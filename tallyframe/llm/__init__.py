"""Operators for training-data pipelines. Nothing else in the library imports this subpackage."""

from . import chat, clusters, decontaminate, jaccard, lines, near_vectors, packing, pii, quality, sharding, spelling, token_counts, token_files

MODULES = (near_vectors, token_files, jaccard, decontaminate, token_counts, quality, pii, sharding, packing, chat, lines, spelling, clusters)
QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
ORACLES = {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
