"""Training-data operators: fingerprints, dedup, mixing, filtering, packing, search and token files.

Nothing else in the library imports this subpackage.
"""
