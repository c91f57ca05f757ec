"""Scalar functions, as Columns built from Spark's own functions."""
