"""Column functions and their numpy twins."""
