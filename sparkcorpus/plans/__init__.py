"""Whole flows: indexing, asking, building topics, evaluating."""
