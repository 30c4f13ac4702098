"""Profiling, cleaning, schema design, verified loads and pipeline operators on Spark DataFrames."""
