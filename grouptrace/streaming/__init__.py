"""Incremental ingest of registry pages."""
