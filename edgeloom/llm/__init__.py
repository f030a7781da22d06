"""Training-data operators: packing, mixing, deduplication, media, scoring.

Nothing else in the library imports this subpackage.
"""
