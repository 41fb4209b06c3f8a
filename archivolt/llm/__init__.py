"""Operators that prepare archive text as training data.

Nothing else in the library imports this subpackage.
"""
