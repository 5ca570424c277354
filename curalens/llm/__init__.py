"""Operators of a training-data pipeline: scoring, filtering, de-duplication, tokens and packing."""
