"""Structured Streaming forms of the batch loops."""
