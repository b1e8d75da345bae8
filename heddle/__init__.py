"""heddle: long-context research data and training-corpus operators as Spark DataFrames."""

__version__ = "0.1.0"
