"""Readers, writers and the stored stages between them."""
