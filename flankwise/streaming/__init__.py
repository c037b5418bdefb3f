"""Incremental runs. The engine is batch only; this holds resumable processing."""
