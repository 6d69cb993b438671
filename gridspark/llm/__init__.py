"""Operators of a training-data pipeline: deduplication, filtering, mixing, attribution and extraction."""
