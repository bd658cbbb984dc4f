"""Column functions that the operators need."""
