"""Operators of the clustering engine."""
