"""Streaming of the clustering engine."""
