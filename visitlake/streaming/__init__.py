"""Incremental backup with Structured Streaming."""
