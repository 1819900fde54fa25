"""Registered queries over the given tables, with the SQL that checks them."""

from suite import checks, jobs, scalar, tables  # noqa: F401
from suite.registry import QUERIES

__all__ = ["QUERIES"]
