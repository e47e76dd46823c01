"""Spark-first library for checked, repeatable work on lists, forms, events and documents."""

from pyspark import cloudpickle as _cloudpickle

# Functions sent to executors carry their code along, so executors need no installation.
_cloudpickle.register_pickle_by_value(__import__(__name__))

__version__ = "0.1.0"
