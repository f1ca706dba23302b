"""Structured Streaming over the vote log."""
