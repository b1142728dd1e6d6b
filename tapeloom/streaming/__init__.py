"""Structured Streaming forms of the trade and bar operators."""
