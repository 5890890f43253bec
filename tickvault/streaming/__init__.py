"""Structured Streaming form of the merge."""
