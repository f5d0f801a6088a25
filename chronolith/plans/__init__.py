"""Query plans: importing this package registers every query."""

from . import analyses, ancestry, derivations, graphs, more, reads, resolutions, retractions, streams, targets, texts, whys  # noqa: F401
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
