"""Structured Streaming runners (micro-batch booking)."""
