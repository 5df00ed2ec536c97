"""Operators for large training-text pipelines.

Every operator takes and returns DataFrames. Nothing outside this subpackage imports it.
"""
