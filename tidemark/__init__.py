"""tidemark: point-in-time (bitemporal) market analytics on PySpark DataFrames."""

__version__ = "0.1.0"
