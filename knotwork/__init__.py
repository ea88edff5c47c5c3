"""Knotwork: a property-graph traversal engine on Spark DataFrames."""
