"""Sources of the clustering engine."""
