"""Causal-state analytics of symbol sequences on Spark DataFrames."""
