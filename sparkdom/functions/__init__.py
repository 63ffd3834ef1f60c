"""Column functions over node rows, and functions for SQL."""
