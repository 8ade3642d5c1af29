"""Long-term-memory analytics on Spark: DataFrames in, DataFrames out."""
