"""Behavioural profiles from event data, as Spark jobs: every function takes and returns DataFrames."""
