"""Structured Streaming ingest of availability snapshots."""
