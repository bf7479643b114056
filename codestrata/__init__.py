"""codestrata: set-at-a-time retrieval, graph and evaluation operators on Spark DataFrames."""

__version__ = "0.1.0"
