"""Structured Streaming versions of the ingest, limit and state operators, each with a batch twin."""
