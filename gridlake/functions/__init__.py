"""Scalar Column expressions: text, numbers, dates and value classes."""
