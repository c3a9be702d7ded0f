"""Speech-corpus preparation and evaluation statistics as Spark DataFrames."""

__version__ = "0.1.0"
