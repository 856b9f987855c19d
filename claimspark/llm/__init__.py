"""Operators of a training-data pipeline: filtering, near duplicates, search, scoring, mixing, sharding."""
