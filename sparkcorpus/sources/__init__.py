"""Readers, writers and the codecs between them."""
