"""Column helpers, exact order statistics and fixed values."""
