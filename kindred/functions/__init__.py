"""Functions of the clustering engine."""
