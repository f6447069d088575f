"""Shared pieces: tables in the shared folder, bounded broadcasts, word and shingle hashes."""

from __future__ import annotations

import ctypes
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tableworks.session import scratch_path

#: Id tables up to so many rows (8 bytes each) may be broadcast; larger ones are shuffled.
BROADCAST_IDS = 1_000_000
#: Deleted from a text before it is cut into words, so that copies may differ in punctuation.
PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
SHINGLE = 5
BATCH_ROWS = 500
BATCH_KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back. Cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def short_batches(spark: SparkSession):
    """Inside, texts go to Python in Arrow batches of at most BATCH_ROWS rows, which bounds the memory of both sides. What is lazy has to
    be written inside; afterwards the session has its own setting again."""
    before = spark.conf.get(BATCH_KEY, None)
    spark.conf.set(BATCH_KEY, str(BATCH_ROWS))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(BATCH_KEY)
        else:
            spark.conf.set(BATCH_KEY, before)


def shorten_batches(spark: SparkSession) -> None:
    """The same for results that run later, when the caller asks for them: the session keeps the setting."""
    spark.conf.set(BATCH_KEY, str(BATCH_ROWS))


def release() -> None:
    """Give freed memory back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def released(run):
    """``run`` over the batches of a task; what the task has freed then goes back to the system, as workers live on."""

    def whole(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return whole


def dropped(*tables: DataFrame) -> None:
    """Remove tables made by ``stored`` that no later step reads."""
    for table in tables:
        spark = table.sparkSession
        for folder in {f.rpartition("/")[0] for f in table.inputFiles()}:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(df: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """Rows of ``df`` whose ``column`` is in ``ids`` (one distinct column of that name). A small id table is broadcast, so that
    the texts of all other rows are not shuffled."""
    small = ids.count() <= BROADCAST_IDS
    return df.join(F.broadcast(ids) if small else ids, column, "left_semi")


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (wraps on purpose)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def uniform(x: np.ndarray) -> np.ndarray:
    """Hashes to numbers in (0, 1]."""
    return ((x >> np.uint64(11)).astype(np.float64) + 1.0) * 2.0**-53


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_QUIET = _SPACE.copy()
_QUIET[list(PUNCTUATION)] = True
_LOWER = np.arange(256)
_LOWER[65:91] += 32
_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[_LOWER]


class Words:
    """Words of many texts: runs without ASCII white space, compared without ASCII case and punctuation; those of punctuation only
    are left out. ``start`` and ``end`` are bytes within the text, ``line`` numbers lines over all texts, ``stop`` marks the end of a
    sentence or clause, ``hash`` is a 64-bit hash of what is compared; ``starts`` says where each text's words start (one more than texts)."""

    def __init__(self, texts: list[bytes]):
        sizes = np.array([len(t) + 1 for t in texts], np.int64)
        raw = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
        solid = ~_SPACE[raw]
        edge = np.diff(np.concatenate(([0], solid.astype(np.int8), [0])))
        first, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        loud = ~_QUIET[raw]
        count = np.concatenate(([0], np.cumsum(loud)))
        some = count[end] > count[first]
        first, end = first[some], end[some]
        length = count[end] - count[first]
        at = np.maximum(count[:-1] - np.repeat(np.concatenate(([0], count[first])), np.diff(np.concatenate(([0], first, [len(raw)])))), 0)
        at = np.where(loud, at, 0)
        powers = np.cumprod(np.full(int(at.max(initial=0)) + 1, 0xD6E8FEB86659FD93, np.uint64))
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(np.where(loud, _VALUE[raw] * powers[at], np.uint64(0)), dtype=np.uint64)))
        self.hash = mix(total[end] - total[first] + length.astype(np.uint64))
        origin = np.cumsum(sizes) - sizes
        self.text = np.searchsorted(origin, first, side="right") - 1
        self.start, self.end = first - origin[self.text], end - origin[self.text]
        self.line = np.concatenate(([0], np.cumsum(raw == 10)))[first]
        self.stop = np.isin(raw[end - 1], [ord(c) for c in ".!?,;:"]) if len(end) else np.zeros(0, bool)
        self.starts = np.searchsorted(self.text, np.arange(len(texts) + 1))


def shingles(hashes: np.ndarray, starts: np.ndarray, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of runs of ``n`` words and the document of each; a shorter document is one run of all its words."""
    if not len(hashes):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    size = np.diff(starts)[owner]
    at = np.arange(len(hashes)) - starts[:-1][owner]
    out = np.zeros(len(hashes), np.uint64)
    padded = np.concatenate((hashes, np.zeros(n, np.uint64)))
    for i in range(n):
        inside = at + i < size
        out = out * np.uint64(0x9FB21C651E98DF25) + np.where(inside, padded[i : i + len(hashes)], np.uint64(1))
    whole = (at + n <= size) | (at == 0)
    return mix(out[whole]), owner[whole]


def counted(shingle: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (document, shingle) in order, and how often each occurs."""
    if not len(shingle):
        return shingle, owner, np.zeros(0)
    order = np.lexsort((shingle, owner))
    s, o = shingle[order], owner[order]
    first = np.concatenate(([True], (s[1:] != s[:-1]) | (o[1:] != o[:-1])))
    at = np.flatnonzero(first)
    return s[at], o[at], np.diff(np.concatenate((at, [len(s)]))).astype(np.float64)


def portions(text: str | None, breaks: np.ndarray, size: int):
    """A text as bytes, in parts of about ``size`` that end before one of the bytes marked in ``breaks``, and whether a part is the
    last. A run without such bytes is never cut."""
    data = (text or "").encode()
    while len(data) > size:
        found = np.flatnonzero(breaks[np.frombuffer(data, np.uint8, size)])
        cut = int(found[-1]) if len(found) else 0
        if cut == 0:
            rest = breaks[np.frombuffer(data, np.uint8)[1:]]
            cut = 1 + int(rest.argmax()) if rest.any() else len(data)
            if cut == len(data):
                break
        yield data[:cut], False
        data = data[cut:]
    yield data, True
