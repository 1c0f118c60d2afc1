"""Passage search, attribution and comparison over paged books, on Spark DataFrames."""
