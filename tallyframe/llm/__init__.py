"""Operators of a training-data pipeline over documents, pages and vectors.

Each module holds one operator; ``queries`` registers one query for each over the driver tables.
Nothing else in the library imports this subpackage.
"""
