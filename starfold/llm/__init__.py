"""Training-data operators: tokenizing, deduplication, classification, search and packing.

Nothing else in the library imports this subpackage; ``queries`` registers its
queries and ``oracles`` their SQL.
"""
