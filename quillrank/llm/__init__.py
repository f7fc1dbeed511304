"""Operators that prepare text for training: cleaning, deduplication, filtering, mixing, packing.

Nothing else in the package imports this one. Each module has one operator; ``queries`` applies them to the test tables.
"""
