"""Build-trace analytics on Spark: graphs, spans, process logs and element logs as DataFrames."""

__version__ = "0.1.0"
