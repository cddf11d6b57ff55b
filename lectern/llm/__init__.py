"""Operators for training-data pipelines over the `documents` and `pages` tables.

Nothing outside this subpackage imports it.
"""
