"""Meter-stream analytics and billing on Spark DataFrames, SQL and Structured Streaming."""
