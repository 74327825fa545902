"""Structured Streaming forms of keyed-state operators."""
