"""Repeated runs of words within a text."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

WORDS = re.compile(r"[^\W_]+")


def covered_share(text: str, n: int) -> float:
    """Share of the characters of words that lie in a run of ``n`` words occurring more than once; overlapping runs count once."""
    found = WORDS.findall(text.lower())
    if len(found) < n:
        return 0.0
    names = {w: i for i, w in enumerate(dict.fromkeys(found))}
    code = np.array([names[w] for w in found], np.uint64)
    rolling = np.zeros(len(code) - n + 1, np.uint64)
    for k in range(n):  # codes are exact as long as the number of words to the power n is below 2**64, else a hash
        rolling = rolling * np.uint64(max(len(names), 2) | 1) + code[k : len(code) - n + 1 + k]
    _, back, count = np.unique(rolling, return_inverse=True, return_counts=True)
    edge = np.zeros(len(code) + 1, np.int64)
    at = np.flatnonzero(count[back] > 1)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + n, -1)
    size = np.array([len(w) for w in found])
    return float(size[np.cumsum(edge)[:-1] > 0].sum() / size.sum())


def repeated_share(n: int):
    """Column function of ``covered_share``."""

    @F.pandas_udf("double")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: covered_share(t or "", n))

    return run
