"""Operators for preparing language-model training data.

Nothing else in the library imports this subpackage.  Every operator module
exposes plain functions on DataFrames; ``registry`` lists the registered
queries and their SQL.
"""
