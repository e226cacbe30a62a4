"""System-profiling analytics on Spark DataFrames."""
