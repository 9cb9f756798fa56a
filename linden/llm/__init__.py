"""Operators of a training-data pipeline, each one a Spark job.

Nothing else in the library imports this subpackage; ``queries`` holds the
named queries over the driver tables.
"""
