"""Operators for training-data pipelines: ten methods, their queries and their SQL."""
