"""Scalar, array, financial and statistical functions, and functions that scripts define."""
