"""All queries of this package, and their SQL."""

from __future__ import annotations

from weft.llm import q_canon, q_levels, q_names, q_near, q_sizes, q_split, q_vectors

_MODULES = [q_canon, q_levels, q_names, q_near, q_sizes, q_split, q_vectors]
QUERIES = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
ORACLES = {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}
