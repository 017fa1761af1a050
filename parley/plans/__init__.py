"""Registered queries; importing the modules fills the registry."""

from parley.plans.registry import ORACLES, QUERIES  # noqa: F401
from parley.plans import (  # noqa: F401, I001
    queries_ingest,
    queries_cluster,
    queries_enrich,
    queries_graph,
    queries_retrieve,
    queries_similar,
    queries_stats,
    queries_streaming,
)
