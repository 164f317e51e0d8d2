"""Queries over the driver's tables with the SQL that they are compared with."""

from . import catalog, checks, lines, structures

__all__ = ["catalog", "checks", "lines", "structures"]
