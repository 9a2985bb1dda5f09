"""Operators for large text corpora (training-data preparation).

Nothing outside this package imports it; deleting it leaves the rest working.
"""
