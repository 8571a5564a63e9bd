"""Index store and vector tables."""
