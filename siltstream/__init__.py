"""Durable-ingest and delivery analytics on Spark DataFrames."""
