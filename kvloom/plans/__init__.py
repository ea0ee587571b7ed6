"""The search query tree, its text forms, and its compiler to DataFrames."""
