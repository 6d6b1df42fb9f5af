"""Column builders: text, query, vector and JSON functions."""
