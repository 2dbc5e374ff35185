"""User-level jobs over a table store."""
