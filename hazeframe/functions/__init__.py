"""Column functions and validation."""
