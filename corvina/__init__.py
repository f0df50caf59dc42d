"""Corvina: Spark-native analytics over news archives.

Every public operator takes DataFrames and column names and returns a lazy
DataFrame.  Nothing is collected except values whose size does not grow with
the data (model parameters, per-source totals below a checked bound).
"""

__version__ = "0.1.0"
