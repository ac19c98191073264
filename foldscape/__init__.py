"""Foldscape: state-space forecasting and observable selection on Spark DataFrames."""

__version__ = "0.1.0"
