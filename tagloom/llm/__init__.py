"""Operators for large text corpora; nothing else in the library imports this."""

from tagloom.llm.oracle import ORACLE
from tagloom.llm.queries import QUERIES

__all__ = ["ORACLE", "QUERIES"]
