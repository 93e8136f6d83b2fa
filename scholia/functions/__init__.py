"""Scalar functions and validation rules."""
