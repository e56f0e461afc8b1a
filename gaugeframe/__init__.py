"""Benchmark scores as measurements, computed with Spark DataFrames."""
