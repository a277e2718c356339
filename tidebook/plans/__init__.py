"""The reference queries: each a DataFrame plan over the driver's tables, with its SQL."""

from . import analytics, dynamics, features, marks, relations, simulations, sources, streams
from .registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES", "analytics", "dynamics", "features", "marks", "relations", "simulations", "sources", "streams"]
