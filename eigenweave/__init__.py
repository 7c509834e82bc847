"""Multi-party principal component analysis on Spark DataFrames."""
