"""A sequence of token ids as a wavelet matrix in one compressed file."""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs

MAGIC = b"WVLTMTX1"
#: Bits of a plane that are compressed together; what one look-up has to unpack.
BLOCK = 1 << 19


def _codec() -> pa.Codec:
    return pa.Codec("zstd", compression_level=3)


def _packed(values: np.ndarray) -> bytes:
    return _codec().compress(np.ascontiguousarray(values, np.int64).tobytes(), asbytes=True)


def _unpacked(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(_codec().decompress(data, decompressed_size=8 * n, asbytes=True), np.int64) if n else np.zeros(0, np.int64)


def write(path: str, ids: np.ndarray, doc_ids: list[int | None], ends: list[int], before: int, closed: bool) -> int:
    """Write ``ids`` to ``path`` and return the bytes written.

    Plane by plane from the highest bit, ids are parted by that bit, zeros first, each side in its order; the bits before parting are
    the plane. Blocks of a plane are compressed one by one; the directory has their places and how many ones stand before each. The
    documents' ids and the ends of their tokens follow. ``before`` tokens of the first document stand in an earlier file;
    ``closed`` tells whether the last document ends here.
    """
    n = len(ids)
    bits = max(1, int(ids.max(initial=0)).bit_length())
    now, zeros, blocks, ones = ids, [], [], []
    for level in range(bits):
        bit = ((now >> (bits - 1 - level)) & 1).astype(bool)
        zeros.append(int(n - np.count_nonzero(bit)))
        total = 0
        for lo in range(0, n, BLOCK):
            part = bit[lo : lo + BLOCK]
            blocks.append(_codec().compress(np.packbits(part, bitorder="little").tobytes(), asbytes=True))
            ones.append(total)
            total += int(np.count_nonzero(part))
        if level < bits - 1:
            now = np.concatenate((now[~bit], now[bit]))
    known = np.array([d is not None for d in doc_ids], np.int64)
    tables = [_packed(x) for x in ([len(b) for b in blocks], ones, [d or 0 for d in doc_ids], known, ends)]
    head = {"n": n, "bits": bits, "zeros": zeros, "docs": len(ends), "before": before, "closed": closed, "tables": [len(t) for t in tables]}
    text = json.dumps(head).encode()
    store, place = fs.FileSystem.from_uri(path)
    store.create_dir(place.rpartition("/")[0], recursive=True)
    with store.open_output_stream(place, compression=None) as out:
        for part in (MAGIC, len(text).to_bytes(8, "little"), text, *tables, *blocks):
            out.write(part)
        return out.tell()


class Sequence:
    """A written file: access, counting and look-up of occurrences read only the blocks they need."""

    def __init__(self, path: str):
        store, place = fs.FileSystem.from_uri(path)
        self.file = store.open_input_file(place)
        if self.file.read_at(8, 0) != MAGIC:
            raise ValueError(f"{path} is no token file")
        size = int.from_bytes(self.file.read_at(8, 8), "little")
        head = json.loads(self.file.read_at(size, 16))
        self.n, self.bits, self.zeros, self.before, self.closed = (head[k] for k in ("n", "bits", "zeros", "before", "closed"))
        self.per_plane = -(-self.n // BLOCK)
        at, tables = 16 + size, []
        for length, n in zip(head["tables"], [*[self.bits * self.per_plane] * 2, *[head["docs"]] * 3]):
            tables.append(_unpacked(self.file.read_at(length, at), n))
            at += length
        sizes, ones, docs, known, self.ends = tables
        self.doc_ids = [int(d) if k else None for d, k in zip(docs, known)]
        self.places = at + np.concatenate(([0], np.cumsum(sizes)))
        self.ones = ones.reshape(self.bits, self.per_plane)
        self.block = lru_cache(maxsize=4 * self.bits)(self._block)

    def __enter__(self):
        return self

    def __exit__(self, *error):
        self.file.close()

    def __len__(self):
        return self.n

    def _block(self, level: int, k: int) -> np.ndarray:
        at = level * self.per_plane + k
        n = min(BLOCK, self.n - k * BLOCK)
        data = self.file.read_at(int(self.places[at + 1] - self.places[at]), int(self.places[at]))
        packed = _codec().decompress(data, decompressed_size=-(-n // 8), asbytes=True)
        return np.unpackbits(np.frombuffer(packed, np.uint8), count=n, bitorder="little")

    def _ones(self, level: int) -> int:
        return self.n - self.zeros[level]

    def _look(self, level: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bits at the places ``at`` (0 at the end), and how many ones stand before each."""
        bit, rank = np.zeros(len(at), np.int64), np.full(len(at), self._ones(level), np.int64)
        own = at // BLOCK
        for k in np.unique(own[at < self.n]).tolist():
            mine = np.flatnonzero((own == k) & (at < self.n))
            block = self.block(level, k)
            inside = at[mine] - k * BLOCK
            bit[mine] = block[inside]
            rank[mine] = self.ones[level, k] + np.concatenate(([0], np.cumsum(block)))[inside]
        return bit, rank

    def _find(self, level: int, bit: int, nth: np.ndarray) -> np.ndarray:
        """Places of the ``nth`` (from 0) zeros or ones of a plane."""
        starts = self.ones[level] if bit else np.arange(self.per_plane) * BLOCK - self.ones[level]
        own = np.searchsorted(starts, nth, side="right") - 1
        out = np.zeros(len(nth), np.int64)
        for k in np.unique(own).tolist():
            mine = own == k
            out[mine] = k * BLOCK + np.flatnonzero(self.block(level, k) == bit)[nth[mine] - starts[k]]
        return out

    def tokens(self, at) -> np.ndarray:
        """The ids at given places."""
        at = np.asarray(at, np.int64)
        value = np.zeros(len(at), np.int64)
        for level in range(self.bits):
            bit, rank = self._look(level, at)
            value = value * 2 + bit
            at = np.where(bit == 1, self.zeros[level] + rank, at - rank)
        return value

    def _span(self, token: int, lo: int, hi: int) -> tuple[int, int]:
        """Where the occurrences of ``token`` in [lo, hi) stand below the last plane."""
        if token < 0 or token >> self.bits:
            return 0, 0
        for level in range(self.bits):
            _, (a, b) = self._look(level, np.array([lo, hi]))
            lo, hi = (self.zeros[level] + a, self.zeros[level] + b) if token >> (self.bits - 1 - level) & 1 else (lo - a, hi - b)
        return int(lo), int(hi)

    def count(self, token: int, lo: int = 0, hi: int | None = None) -> int:
        """How often ``token`` occurs at the places lo to hi, without hi."""
        a, b = self._span(token, lo, self.n if hi is None else hi)
        return b - a

    def occurrences(self, token: int, lo: int = 0, hi: int | None = None) -> np.ndarray:
        """Places of ``token`` in [lo, hi), ascending."""
        a, b = self._span(token, lo, self.n if hi is None else hi)
        at = np.arange(a, b)
        for level in reversed(range(self.bits) if b > a else []):
            one = token >> (self.bits - 1 - level) & 1
            at = self._find(level, one, at - self.zeros[level] if one else at)
        return at

    def all(self) -> np.ndarray:
        """Every id in order: planes are merged back from the last to the first."""
        kind = np.uint16 if self.bits <= 16 else np.uint32
        now = np.zeros(self.n, kind)
        for level in reversed(range(self.bits)):
            bit = np.concatenate([self._block(level, k) for k in range(self.per_plane)]).astype(bool) if self.n else np.zeros(0, bool)
            back = np.empty(self.n, kind)
            back[~bit] = now[: self.zeros[level]]
            back[bit] = now[self.zeros[level] :] | kind(1 << (self.bits - 1 - level))
            now = back
        return now
