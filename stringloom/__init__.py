"""Compressed string columns on Spark: learn a dictionary, encode rows, search the codes."""
