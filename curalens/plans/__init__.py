"""Registered queries: operators bound to the supplied tables."""
