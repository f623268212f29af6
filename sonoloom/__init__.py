"""Spark-first analytics engine for study-based media cohorts.

Every operator takes DataFrames and returns a DataFrame; nothing is collected
unless a docstring names the bound of what is collected.
"""

__version__ = "0.1.0"
