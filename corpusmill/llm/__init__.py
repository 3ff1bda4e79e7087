"""Training-data operators: filtering, deduplication, extraction, packing.

Nothing outside this subpackage imports it.
"""
