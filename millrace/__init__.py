"""millrace: corpus preparation, auditing and governed aggregation on Spark."""

__version__ = "0.1.0"
