"""An analytics engine for ordered event data, on Spark's DataFrame API."""
