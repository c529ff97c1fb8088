"""Operators for preparing training data, each a DataFrame-in, DataFrame-out function."""
