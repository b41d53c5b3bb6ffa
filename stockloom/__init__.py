"""Retail demand analytics as PySpark DataFrame functions.

Every operator takes DataFrames and returns a DataFrame; nothing is computed
until the caller writes or collects.  See README.md for the operator index.
"""

__version__ = "0.1.0"
