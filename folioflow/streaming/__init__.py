"""Structured Streaming: incremental ingest, a usage ledger and event windows."""
