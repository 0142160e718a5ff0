"""Structured Streaming forms of the log and interval operators."""
