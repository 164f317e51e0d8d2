"""Gated sources and fresh sinks."""
