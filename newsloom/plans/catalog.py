"""All driver queries and their SQL."""

from . import intake, reports, rows, scalars, series  # noqa: F401  (importing registers the queries)
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
