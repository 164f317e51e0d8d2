"""Structured Streaming forms of operators; an extension, with batch equivalents."""
