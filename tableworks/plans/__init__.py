"""Every registered query; importing a module registers what it holds."""

from . import curation, dialogue, learning, pages, retrieval, streams, tabular  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
