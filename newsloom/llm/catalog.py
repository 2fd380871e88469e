"""Registered queries of this folder and their SQL."""

from __future__ import annotations

from . import queries

QUERIES = {name: f for name, f in vars(queries).items() if name.startswith("op")}
ORACLES = dict(queries.SQL)
