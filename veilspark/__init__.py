"""veilspark: sensitive-data detection, scrubbing and text preparation on Spark DataFrames."""

__version__ = "0.1.0"
