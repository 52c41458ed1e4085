"""Sales analytics written as DataFrame-in, DataFrame-out functions on Spark."""
