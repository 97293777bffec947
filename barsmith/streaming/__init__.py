"""Structured Streaming operators (TS1-TS7)."""
