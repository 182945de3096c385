"""Column functions and the fixed values they work with."""
