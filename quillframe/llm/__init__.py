"""Training-data operators: search, dedup, quality, sharding, token stores, mixing.

Self-contained: nothing else in ``quillframe`` imports this subpackage.
"""
