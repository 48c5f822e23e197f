"""pagegrain: page-layout analytics and text data processing on Spark DataFrames."""

__version__ = "0.1.0"
