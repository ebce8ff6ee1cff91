"""Column builders: expressions over whole columns, no Python per row."""
