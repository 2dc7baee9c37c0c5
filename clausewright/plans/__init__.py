"""The engine's named queries: importing this package registers them."""

from . import analytics, checks, extraction, narrative, relational, wording  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
