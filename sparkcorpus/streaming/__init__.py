"""Stateful operators on streaming DataFrames."""
