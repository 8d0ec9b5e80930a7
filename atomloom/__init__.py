"""Sparse Gaussian-process interatomic potentials, and generic point-group analytics, on Spark DataFrames."""
