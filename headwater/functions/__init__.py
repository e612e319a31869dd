"""Column functions and named registries."""
