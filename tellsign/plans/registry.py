"""All registered queries and their SQL twins."""
from __future__ import annotations

from tellsign.plans import catalog, queries_history, queries_io, queries_results, queries_signals, queries_triage  # noqa: F401

QUERIES = catalog.QUERIES
ORACLES = catalog.ORACLES
