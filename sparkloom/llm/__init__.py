"""Operators of a training-data pipeline: sharded binary output, filters, dedup, mixing.

Nothing else in the library imports this subpackage. Each module holds one operator with its
own general interface; ``queries`` holds the thin contract queries.
"""
