"""Scalar functions and the per-file fold."""
