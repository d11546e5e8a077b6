"""A Spark-first engine for schema matching, join discovery and data migration."""

__version__ = "0.1.0"
