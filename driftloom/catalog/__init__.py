"""Runnable queries over the test tables, each with its SQL twin where SQL can say it."""

from __future__ import annotations

from driftloom.catalog import ingest, models, sequences, shape, statistics, streams  # noqa: F401
from driftloom.catalog.inputs import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
