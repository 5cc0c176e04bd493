"""Operators for preparing training text, each a function from DataFrame to DataFrame.

They select the columns they name, so further columns of the input never clash with theirs.
"""
