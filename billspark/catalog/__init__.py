"""Importing this package registers every query."""

from billspark.catalog import extraction, records, resilience, streams, texts  # noqa: F401
from billspark.catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
