"""Listing-curation analytics as Spark DataFrame operators."""
