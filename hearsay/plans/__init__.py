"""Report queries over the stored tables."""
