"""Text retrieval, link analysis and training-data preparation on Spark DataFrames."""
