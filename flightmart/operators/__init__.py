"""User-level operators (O01-O42): DataFrames in, DataFrame out, no actions."""
