"""Panel analytics for price bars on Spark DataFrames."""
