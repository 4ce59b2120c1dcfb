"""Snapshot change capture and document sync on Spark DataFrames."""
