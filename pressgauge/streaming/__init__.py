"""Micro-batch ingestion with idempotent sinks."""
