"""Registered queries over the test tables, with their SQL counterparts."""

from switchyard.catalog import cluster, encode, evaluation, features, ingest, routing, targets  # noqa: F401
from switchyard.catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
