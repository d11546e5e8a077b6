"""Training-data operators: deduplication, quality, extraction, mixing, tokenising, sharding, licence scans.

Nothing else in the library imports this subpackage.
"""
