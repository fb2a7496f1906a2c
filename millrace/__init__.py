"""millrace: relational analytics over versioned Parquet tables, planned by Spark."""

__version__ = "0.1.0"
