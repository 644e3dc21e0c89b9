"""spreadlake: pairs and spread research on Spark DataFrames."""

__version__ = "0.1.0"
