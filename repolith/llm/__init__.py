"""Operators for training-data pipelines over a table of documents.

Every operator takes DataFrames and returns DataFrames.  Nothing else in the
library imports this subpackage.
"""
