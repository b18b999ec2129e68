"""Training-data operators: scoring, deduplication, mixing, formatting and packing.

Nothing else in the library imports this subpackage.
"""
