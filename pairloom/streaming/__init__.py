"""Streaming form of the stateless classification."""
