"""Injected text encoders and the bundled deterministic one."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

Encoder = Callable[[list[str]], np.ndarray]

_WORD = re.compile(r"[^\W_]+")


class HashEncoder:
    """Counts of hashed words, scaled to unit length. Needs no model file."""

    def __init__(self, dim: int = 64):
        self.dim = dim
        self._slots: dict[str, int] = {}

    def _slot(self, word: str) -> int:
        slot = self._slots.get(word)
        if slot is None:
            if len(self._slots) > 200_000:
                self._slots.clear()
            slot = int(hashlib.md5(word.encode()).hexdigest()[:6], 16) % self.dim
            self._slots[word] = slot
        return slot

    def __call__(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim))
        for row, text in enumerate(texts):
            slots = [self._slot(w) for w in _WORD.findall(text.lower())]
            out[row] = np.bincount(slots, minlength=self.dim) if slots else 0
        return out / (np.linalg.norm(out, axis=1, keepdims=True) + 1e-12)


def encode_with(make_encoder: Callable[[], Encoder], batch: int = 8):
    """Column function that builds the encoder once per Python worker and feeds it ``batch``
    texts at a time. A text that is null gives a null vector."""

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = make_encoder()
        for texts in batches:
            known = texts.dropna()
            vectors = []
            for start in range(0, len(known), batch):
                vectors.extend(np.asarray(encoder(list(known.iloc[start:start + batch])), dtype=float))
            yield pd.Series(vectors, index=known.index, dtype=object).reindex(texts.index)

    return run
