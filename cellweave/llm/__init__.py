"""Operators for training-data pipelines: scoring, filtering, cleaning, mixing and sharding of text."""
