"""Content-addressed storage and redundancy analytics on Spark."""

__version__ = "0.1.0"
