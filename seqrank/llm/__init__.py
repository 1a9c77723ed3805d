"""Operators of a training-data pipeline and their registered queries.

Nothing outside this package imports it; ``queries.py`` holds the registered
queries and their SQL twins.
"""
