"""Periodic refresh as Structured Streaming."""
