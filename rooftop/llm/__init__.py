"""Operators of a training-data pipeline: URL reputation, sharding, personal
data, near duplicates, vector search, source mixing, packing, quality rules,
toxicity and token counts.

Each module holds one operator with an interface of its own; ``queries`` has
the thin registered queries.  Nothing else in the package imports this folder.
"""
