"""Stateful streaming ingest."""
