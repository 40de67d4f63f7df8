"""Market tables from the input tables."""
