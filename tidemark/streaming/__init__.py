"""Incremental ledger input with Structured Streaming."""
