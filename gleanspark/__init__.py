"""Set-based operators for web-collection data, written for Spark DataFrames."""

__version__ = "0.1.0"
