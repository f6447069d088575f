"""Importing this module registers every query of the package."""

from . import chat, hamming, langid, lexical, minhash, mixing, passages, pieces, ppm, quality, tokens, trie, vectors  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
