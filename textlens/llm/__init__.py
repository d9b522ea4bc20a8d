"""Training-data operators: deduplication, filtering, privacy, sharding and encoding.

Self-contained: nothing else in the package imports from here.
"""
