"""Paged documents to checked relational tables, as Spark DataFrames."""
