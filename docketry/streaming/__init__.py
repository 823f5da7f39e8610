"""Structured Streaming forms of ingest, acknowledgement, linking and weekly counting."""
