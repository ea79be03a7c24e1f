"""Operators a training-data pipeline needs: quality, deduplication, scoring, mixing, packing.

Nothing outside this subpackage imports it; ``queries`` lists what it offers to the entry module.
"""
