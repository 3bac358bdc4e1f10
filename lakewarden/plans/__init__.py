"""Registered queries: every operator over the lake's tables, with its SQL beside it."""

from . import flow, flagship, governance, graphs, operations, profiles, streams  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
