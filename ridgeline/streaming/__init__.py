"""Structured Streaming forms of mergeable operators."""
