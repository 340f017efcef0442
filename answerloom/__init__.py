"""Data-question operators on Spark DataFrames."""
