"""Operators for training-data pipelines: filtering, counting, searching, deduplicating, mixing, packing.

Nothing outside this subpackage imports it.
"""
