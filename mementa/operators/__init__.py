"""Operators: DataFrame in, DataFrame out, no I/O of their own."""
