"""Operators for training data at corpus scale. Nothing outside this subpackage imports it."""

from millrace.llm.queries import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
