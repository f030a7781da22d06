"""Sparse-graph and row-compression jobs on Spark."""
