"""Operators over DataFrames: grouping, weights, metrics, refusal, heads, evidence and diagnostics."""
