"""Operational intelligence over text and records, expressed as Spark DataFrames."""
