"""Structured Streaming jobs over ledger shards and predictions."""
