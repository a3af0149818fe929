"""Structured Streaming jobs for live ingest, enrichment and alerts."""
