"""Schemas of the two kinds of event logs."""

EVENT = (
    "n BIGINT, event_id BIGINT, process STRING, case_id STRING, activity STRING, ts TIMESTAMP, "
    "event_attrs MAP<STRING, STRING>, trace_attrs MAP<STRING, STRING>, process_attrs MAP<STRING, STRING>"
)
OC_EVENT = "n BIGINT, event_id STRING, activity STRING, ts TIMESTAMP, omap MAP<STRING, ARRAY<STRING>>, vmap MAP<STRING, STRING>"
