"""Recursive text splitting: coarse separators first, finer ones only where a piece is too long."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F

from ..fixed_values import CHUNK_OVERLAP, CHUNK_SIZE, SPLIT_SEPARATORS


def _pieces(text: str, sep: str) -> list[str]:
    """Split and keep each separator at the head of the piece that follows it."""
    if not sep:
        return list(text)
    head, *rest = text.split(sep)
    return [p for p in [head, *(sep + r for r in rest)] if p]


def _pack(pieces: list[str], size: int, overlap: int) -> Iterator[str]:
    """Join neighbouring pieces greedily; a new chunk starts with a tail of the last one."""
    window: list[str] = []
    held = 0
    for piece in pieces:
        if window and held + len(piece) > size:
            yield "".join(window)
            while window and (held > overlap or held + len(piece) > size):
                held -= len(window.pop(0))
        window.append(piece)
        held += len(piece)
    if window:
        yield "".join(window)


def split_recursive(text: str, size: int, overlap: int, separators: list[str]) -> list[str]:
    sep_at = next((i for i, s in enumerate(separators) if not s or s in text), len(separators) - 1)
    finer = separators[sep_at + 1:]
    out: list[str] = []
    fitting: list[str] = []
    for piece in _pieces(text, separators[sep_at]):
        if len(piece) < size:
            fitting.append(piece)
            continue
        out.extend(_pack(fitting, size, overlap))
        fitting = []
        out.extend(split_recursive(piece, size, overlap, finer) if finer else [piece])
    out.extend(_pack(fitting, size, overlap))
    return [c for c in (chunk.strip() for chunk in out) if c]


def recursive_chunks(size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP, separators: list[str] = SPLIT_SEPARATORS):
    """Arrow-batched column function from a text to its chunks."""

    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: split_recursive(t, size, overlap, separators) if t else [])

    return run
