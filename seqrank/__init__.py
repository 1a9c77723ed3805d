"""Sequence-mutation scoring, leakage-safe splitting and model evaluation on Spark.

Every operator is a function ``DataFrame -> DataFrame`` (or a ``Column``
expression); nothing here holds rows outside Spark.
"""
