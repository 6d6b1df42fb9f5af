"""Operators over the document model, each a function from DataFrames to DataFrames."""
