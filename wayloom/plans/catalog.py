"""All queries outside of texts, by name."""

from __future__ import annotations

from wayloom.plans import derived, pipelines

QUERIES = {**pipelines.QUERIES, **derived.QUERIES}
ORACLES = {**pipelines.ORACLES, **derived.ORACLES}
flagship = pipelines.QUERIES["p1_found"]
