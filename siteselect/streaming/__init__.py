"""Incremental ingest of chunk files."""
