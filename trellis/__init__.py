"""Trellis: SPARQL over tables, planned and run as Spark DataFrames."""
