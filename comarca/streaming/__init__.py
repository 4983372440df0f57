"""Incremental counterparts of the batch operators, on Structured Streaming."""
