"""Registered queries with their SQL twins."""

from terrapanel.registry import panel, population, quality, reads, scans, storage  # noqa: F401
from terrapanel.registry.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
