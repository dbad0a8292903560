"""Structured Streaming ingest of operation logs."""
