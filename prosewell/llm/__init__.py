"""Training-data operators: deduplication, filtering, scoring, mixing, encoding and media columns.

Nothing else in the package imports this subpackage.  Each module is one operator; ``queries`` registers them.
"""
