"""Operators of a training-data pipeline: scoring, near-duplicates, mixing, search, encoding.

Each module holds one operator with its own general interface; ``queries`` binds the operators to the test tables.
Nothing else in the library imports this subpackage.
"""
