"""Column-to-Column building blocks. No Python runs per row in this package."""
