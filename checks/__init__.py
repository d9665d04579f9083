"""Registered queries over the given tables, each with its SQL where SQL can say it."""

from checks.base import QUERIES, SQL
from checks import jobs, scalars, tables, vectors, web  # noqa: F401  (they register themselves)

__all__ = ["QUERIES", "SQL"]
