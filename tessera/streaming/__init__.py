"""Incremental runs of the row-local jobs with Structured Streaming."""
