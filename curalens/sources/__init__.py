"""Readers, writers and the views built over the supplied tables."""
