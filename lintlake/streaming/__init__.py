"""Structured Streaming forms of the sliding peaks and of the single-flight queue."""
