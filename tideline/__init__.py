"""tideline: a Spark-first lakehouse engine for daily market and macro series."""

__version__ = "0.1.0"
