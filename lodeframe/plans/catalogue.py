"""All queries of the library, by name."""

from __future__ import annotations

from . import aggregates, comparison, composites, coverage, filters, issuers, joins, retrieval, runs, scalars, scans, scoring, streams, windows  # noqa: F401
from .registry import ORACLE, QUERIES


def flagship(spark, sf_dir):
    return QUERIES["score_anomaly"](spark, sf_dir)


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(ORACLE)
