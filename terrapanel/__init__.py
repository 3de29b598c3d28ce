"""Regional time-series panels as plain Spark DataFrames.

Operators take and return DataFrames and stay lazy; the few functions that
write or list files say so in their docstring.
"""
