"""Incident analytics on Spark: onsets and causal chains, event-log queries,
alert intake, retrieval, ownership history, report assembly and call telemetry."""
