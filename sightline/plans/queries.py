"""All registered queries of the evidence operators, and the SQL that gives the same rows."""

from __future__ import annotations

from sightline.plans import queries_align, queries_assemble, queries_evaluate, queries_files, queries_more, queries_retrieve, queries_sources
from sightline.plans.frames import arithmetic_rounding

_MODULES = (queries_align, queries_retrieve, queries_evaluate, queries_sources, queries_more, queries_assemble, queries_files)
QUERIES = {k: q for m in _MODULES for k, q in m.QUERIES.items()}
ORACLES = {k: arithmetic_rounding(s) for m in _MODULES for k, s in m.ORACLES.items()}
