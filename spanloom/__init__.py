"""spanloom: text-span processing and agent-trace analytics on Spark DataFrames."""

__version__ = "0.1.0"
