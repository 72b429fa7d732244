"""All queries over the reference's operators, by name, and the SQL that gives the same rows."""

from __future__ import annotations

from .plans import checks, context, docs, intrinsic, sampling, scoring, slicing, temporal

PARTS = (temporal, intrinsic, scoring, slicing, sampling, context, docs, checks)
QUERIES: dict = {k: v for part in PARTS for k, v in part.QUERIES.items()}
ORACLES: dict = {k: v for part in PARTS for k, v in part.ORACLES.items()}
