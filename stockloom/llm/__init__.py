"""Operators for preparing training data: filtering, de-duplication, mixing, packing.

Nothing else in the library imports this package.
"""
