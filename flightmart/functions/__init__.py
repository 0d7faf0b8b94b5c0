"""Column-level helpers shared by the operators (all built-in functions)."""
