"""Change-data analytics on Spark: change events as DataFrames, and operators from DataFrame to DataFrame."""
