"""Column helpers: every function takes and returns ``Column`` objects."""
