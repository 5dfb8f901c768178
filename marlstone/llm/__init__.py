"""Operators for large training-text collections. Nothing outside this package imports it."""
