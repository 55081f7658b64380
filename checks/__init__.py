"""Queries over the given tables, each with the SQL it must agree with."""

from importlib import import_module

QUERY_MODULES = [import_module(f"checks.{name}") for name in ("q_catalogue", "q_triples", "q_ingest", "q_enrich", "q_reason", "q_extract", "q_quality", "q_stream", "q_facade",
    "q_intervals", "q_incremental")]
