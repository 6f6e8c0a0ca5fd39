"""The registry: query name -> Spark function, and query name -> DuckDB oracle."""

from __future__ import annotations

from kelora.plans import composites, entities, evidence, further, journeys, network, reports, rulings, signals, state, statements, traces  # noqa: F401  (importing registers their queries)
from kelora.plans.registry import ORACLES, QUERIES  # noqa: F401

FLAGSHIP = "q_agg02_noisy_or"
