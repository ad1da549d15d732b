"""Lodestone: document-intelligence operators expressed as Spark DataFrames and SQL."""
