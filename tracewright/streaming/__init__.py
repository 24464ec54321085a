from .miners import (
    aer_lossy_stream,
    closed_cases,
    frequent_only,
    heuristics_lossy_stream,
    simple_dfg_stream,
    temporal_conformance_stream,
    temporal_profile_stream,
)
from .processors import (
    behavioral_conformance_stream,
    dfg_stream,
    directly_follows_stream,
    dot_sink,
    event_time_counts,
    heuristics_budget_stream,
    soft_conformance_stream,
)

__all__ = [
    "aer_lossy_stream",
    "behavioral_conformance_stream",
    "closed_cases",
    "dfg_stream",
    "directly_follows_stream",
    "dot_sink",
    "event_time_counts",
    "frequent_only",
    "heuristics_budget_stream",
    "heuristics_lossy_stream",
    "simple_dfg_stream",
    "soft_conformance_stream",
    "temporal_conformance_stream",
    "temporal_profile_stream",
]
