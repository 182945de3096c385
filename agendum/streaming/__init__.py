"""Structured Streaming twins of the time-driven operators."""
