"""Structured Streaming versions of ingest, dedupe, daily counts and manifest."""
