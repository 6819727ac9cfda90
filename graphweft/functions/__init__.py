"""Scalar functions: versions and ranges, text and path helpers."""
