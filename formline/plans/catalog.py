"""Imports every module that registers queries."""

from . import evaluation_queries, facts_queries, profile_queries, similarity_queries  # noqa: F401
from .registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
