"""Operators for preparing text corpora: filtering, de-duplication, mixing, packaging.

Nothing else in the library imports this subpackage.
"""
