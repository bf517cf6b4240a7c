"""Tidemark: consensus analytics over streams of short documents, on Spark DataFrames."""
