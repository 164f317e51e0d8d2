"""Scalar expressions and structure functions."""
