"""Structured Streaming forms of the store and of read classification."""
