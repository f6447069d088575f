"""Operator 12: token ids of whole documents, written as wavelet matrices in document order and read back."""

from __future__ import annotations

import os
import re
import sys
import types
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tableworks.session import scratch_path

from . import wavelet
from .common import portions, read, released, stored
from .registry import query

END = 2
#: Ids in one file; bounds the memory of writing and reading. A longer document goes on in the next file.
SHARD = 1 << 22
#: Bytes of text encoded together.
SLICE = 1 << 23
#: Words up to LONG bytes are kept with their ids by a worker, in KEPT bytes of memory.
LONG, KEPT = 64, 48 << 20

_RUNS = re.compile("[a-z]+|[0-9]|[^a-z0-9]+")
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class WordCoder:
    """Ids of texts by a tokenizer that cuts at white space and lower-cases.

    Such a tokenizer treats words apart, so each distinct word is encoded once. ``encode`` takes pieces of texts that end where a
    word ends, and gives all ids and the number of ids of each piece.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.kind = np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        self.by_model = self._same([b"a", b"the", b"zq7,x..", b"12", b"(a)b-c_d", b"%%%", b"x=y", b"longerword!?"])
        self._forget()

    def _forget(self):
        self.words = pa.array([], pa.large_binary())
        self.size, self.first, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, self.kind)

    def _by_model(self, word: str) -> list[int]:
        """Ids of a printable ASCII word without an apostrophe: its runs of letters and of signs, and its digits, each by the tokenizer's model."""
        return [t.id for run in _RUNS.findall(word) for t in self.tokenizer.model.tokenize(run)]

    def _same(self, words: list[bytes]) -> bool:
        """Whether the tokenizer treats these words as ``_by_model`` does."""
        return all(self._by_model(w.decode()) == self.tokenizer.encode(w.decode(), add_special_tokens=False).ids for w in words)

    def _ids(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The number of ids of each word, and all ids. Simple words go past the tokenizer's normalizer, which costs most of its time."""
        texts = [w.decode() for w in words.to_pylist()]
        simple = [self.by_model and t.isascii() and t.isprintable() and "'" not in t and "<|" not in t for t in texts]
        found = [self._by_model(t) if s else None for t, s in zip(texts, simple)]
        rest = [t for t, s in zip(texts, simple) if not s]
        if rest:
            encoded = self.tokenizer.encode_batch([rest], is_pretokenized=True, add_special_tokens=False)[0]
            cut = np.concatenate(([0], np.cumsum(np.bincount(np.array(encoded.word_ids, np.int64), minlength=len(rest))))).tolist()
            ids, k = encoded.ids, 0
            for i, s in enumerate(simple):
                if not s:
                    found[i] = ids[cut[k] : cut[k + 1]]
                    k += 1
        return np.array([len(f) for f in found], np.int64), np.fromiter((i for f in found for i in f), self.kind)

    def encode(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        lengths = np.array([len(p) + 1 for p in pieces], np.int64)
        raw = _LOWER[np.frombuffer(b"\n".join([*pieces, b""]), np.uint8)]
        solid = ~_BLANK[raw]
        edge = np.flatnonzero(np.diff(np.concatenate(([0], solid.view(np.int8)))))
        start, end = edge[::2], edge[1::2]
        if not len(start):
            return np.zeros(0, self.kind), np.zeros(len(pieces), np.int64)
        at = np.concatenate(([0], np.cumsum(end - start)))
        words = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(at), pa.py_buffer(raw[solid])])
        words = pc.dictionary_encode(words)
        distinct = words.dictionary
        known = pc.fill_null(pc.index_in(distinct, value_set=self.words), -1).to_numpy().astype(np.int64)
        missing = known < 0
        new = distinct.filter(pa.array(missing))
        if len(new):
            size, flat = self._ids(new)
            known[missing] = np.arange(len(self.words), len(self.words) + len(new))
            self.first = np.concatenate((self.first, len(self.flat) + np.cumsum(size) - size))
            self.size, self.flat = np.concatenate((self.size, size)), np.concatenate((self.flat, flat))
            self.words = pa.concat_arrays([self.words, new])
        entry = known[words.indices.to_numpy()]
        size = self.size[entry]
        upto = np.concatenate(([0], np.cumsum(size)))
        ids = self.flat[np.arange(upto[-1]) + np.repeat(self.first[entry] - upto[:-1], size)]
        cut = np.searchsorted(start, np.concatenate(([0], np.cumsum(lengths))))
        counts = upto[cut[1:]] - upto[cut[:-1]]
        self._keep()
        return ids, counts

    def _keep(self):
        """Drop long words, and all once too much is kept."""
        width = pc.binary_length(self.words).to_numpy()
        if width.sum() + 24 * len(width) + self.flat.nbytes > KEPT:
            self._forget()
        elif width.max(initial=0) > LONG:
            short = width <= LONG
            kept = np.repeat(short, self.size)
            self.words, self.size, self.flat = self.words.filter(pa.array(short)), self.size[short], self.flat[kept]
            self.first = np.cumsum(self.size) - self.size


def coder(path: str) -> WordCoder:
    """The coder of this Python worker, kept from task to task."""
    held = sys.modules.setdefault("_tableworks_kept", types.ModuleType("_tableworks_kept")).__dict__
    if path not in held:
        held[path] = WordCoder(path)
    return held[path]


def write_tokens(documents: DataFrame, tokenizer: str, folder: str, end: int = END, shard: int = SHARD) -> DataFrame:
    """Encode ``documents`` (doc_id, text) and write their ids, each document closed by ``end``, to files in ``folder``.

    Returns the list of files (part, seq, path, n_tokens, n_bytes, start), a written table; the files' order is (part, seq), and
    ``start`` counts the ids before a file. Documents are dealt in ranges of doc_id and sorted, so that order is ascending doc_id
    (null first, equal doc_ids by text). A task cuts its range into files of at most ``shard`` ids and holds no more than
    one; a longer document continues in the next file. A task that is run again writes new files; only those of the list count.

    Null and empty texts have the end id only; repeated rows are all written; an empty table gives no file; further columns are
    ignored. The tokenizer must cut at white space; special tokens are not added. ``folder`` must be reachable from all executors.
    """

    def encode(batches):
        part, own, seq = TaskContext.get().partitionId(), coder(tokenizer), 0
        ids, docs, ends, held, before, open_doc = [], [], [], 0, 0, False

        def flush(closed):
            nonlocal ids, docs, ends, held, before, seq
            path = f"{folder}/part-{part:06d}-{seq:05d}-{uuid.uuid4().hex}.wm"
            size = wavelet.write(path, np.concatenate(ids), docs, ends, before, closed)
            row = [[part], [seq], [path], [held], [size]]
            before = 0 if closed else (before if len(docs) == 1 else 0) + held - (ends[-2] if len(ends) > 1 else 0)
            last = docs[-1]
            ids, docs, ends, held, seq = [], [] if closed else [last], [] if closed else [0], 0, seq + 1
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(row, (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64()))], names)

        def put(doc, new, closes):
            """Add ids of a document; yields files that are full."""
            nonlocal held, open_doc
            if not open_doc:
                docs.append(doc)
                ends.append(held)
            open_doc = not closes
            lo = 0
            while lo < len(new):
                if held == shard:
                    yield flush(False)
                take = min(shard - held, len(new) - lo)
                ids.append(new[lo : lo + take])
                held, lo = held + take, lo + take
                ends[-1] = held
            if closes and held == shard:
                yield flush(True)

        def run(names_, pieces, last):
            found, counts = own.encode(pieces)
            upto = np.concatenate(([0], np.cumsum(counts)))
            close = np.array([end], own.kind)
            for k, name in enumerate(names_):
                new = found[upto[k] : upto[k + 1]]
                yield from put(name, np.concatenate((new, close)) if last[k] else new, last[k])

        waiting, size = ([], [], []), 0
        for batch in batches:
            for doc, text in zip(batch.column(0), batch.column(1)):
                for piece, last in portions(text.as_py(), _BLANK, SLICE):
                    for column, value in zip(waiting, (doc.as_py(), piece, last)):
                        column.append(value)
                    size += len(piece) + 1
                    if size >= SLICE:
                        yield from run(*waiting)
                        waiting, size = ([], [], []), 0
        yield from run(*waiting)
        if held:
            yield flush(True)

    names = ["part", "seq", "path", "n_tokens", "n_bytes"]
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    files = stored(ordered.mapInArrow(released(encode), "part int, seq int, path string, n_tokens long, n_bytes long"), "token-files")
    parts = files.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("part_start"))
    inside = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("part_start") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))
    return files.join(parts, "part").select("part", "seq", "path", "n_tokens", "n_bytes", start.alias("start"))


def read_tokens(files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files listed by ``write_tokens`` alone.

    A task reads the files of a part in order, one at a time, and carries the checksum of a document over to the next file.
    """
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"

    def digest(batches):
        state = None
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist()):
                rows = []
                with wavelet.Sequence(path) as tokens:
                    ids, at = tokens.all(), 0
                    for k, (doc, stop) in enumerate(zip(tokens.doc_ids, tokens.ends.tolist())):
                        if k or not tokens.before:
                            state = (doc, start + at, 0, 0)
                        doc, first, n, crc = state
                        state = (doc, first, n + stop - at, zlib.crc32(ids[at:stop].astype("<u4").tobytes(), crc))
                        at = stop
                        if k < len(tokens.ends) - 1 or tokens.closed:
                            rows.append(state)
                columns = [pa.array([r[i] for r in rows], pa.int64()) for i in range(4)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32"])

    parts = files.select("part").distinct().count()  # said outright: so few rows would otherwise be put into one task
    dealt = files.select("part", "seq", "path", "start").repartition(max(1, parts), "part").sortWithinPartitions("part", "seq")
    return dealt.mapInArrow(released(digest), schema)


@query("op12_token_files")
def op12_token_files(spark, sf_dir):
    import public_tokenizers

    files = write_tokens(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), scratch_path(spark, "tokens"))
    return read_tokens(files)
