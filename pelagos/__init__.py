"""Panel and time-series analytics written as Spark DataFrame programs."""
