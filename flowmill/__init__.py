"""flowmill: a declarative data-pipeline engine compiled to Spark DataFrames."""

__version__ = "0.1.0"
