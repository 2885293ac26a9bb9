"""Measure how well labelled data transfers between domains, on Spark DataFrames."""

__version__ = "0.1.0"
