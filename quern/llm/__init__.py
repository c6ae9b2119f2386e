"""Operators for preparing training data.

Self-contained: no other part of the library imports this package.
"""
