"""Structured Streaming forms of the file-version log."""
