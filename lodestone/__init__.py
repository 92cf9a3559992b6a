"""Spark-first retrieval and knowledge analytics over DataFrames."""
