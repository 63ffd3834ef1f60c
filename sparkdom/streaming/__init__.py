"""Pages that keep arriving."""
