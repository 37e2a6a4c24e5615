"""Operators for preparing language-model training data.

The rest of the library does not import this subpackage.
"""
