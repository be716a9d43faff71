"""Vocabulary and reading-difficulty analytics on Spark DataFrames."""
