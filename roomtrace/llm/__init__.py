"""Training-data operators: deduplication, scoring, mixing, packing, search and fingerprints.

Nothing else in the library imports this subpackage.
"""
