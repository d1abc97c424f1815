"""Structured Streaming drains."""
