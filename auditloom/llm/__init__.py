"""Operators for large text and record collections used as training data."""
