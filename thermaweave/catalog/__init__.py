"""Registered queries and their reference SQL."""

from . import combining, donating, gridding, modelling, quality, scoring, storing  # noqa: F401
from .base import ORACLES, QUERIES

__all__ = ["QUERIES", "ORACLES"]
