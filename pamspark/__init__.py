"""Discrete-time competing-risks survival analysis on Spark DataFrames."""
