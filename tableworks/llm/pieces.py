"""Operator 3: SentencePiece encoding and decoding."""

from __future__ import annotations

import math
import re
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import read, released, shorten_batches
from .registry import query

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARKER = "▁"
#: So far below the lowest score of a piece is that of a byte, used where no piece covers a character.
UNKNOWN = 10.0
#: Segments whose best path a worker keeps, twice: a full table becomes the older one, from which segments still in use move on.
#: Only segments of up to LONG characters are kept. Bounds memory, not results.
CACHE, LONG = 120_000, 64


class DoubleArray:
    """Trie over bytes in two arrays: the child of state s by byte c is base[s] + c + 1 if check there is s."""

    def __init__(self, keys: dict[bytes, int]):
        self.base, self.check, self.value = [0], [-1], [-1]
        tree: list[dict[int, int]] = [{}]
        ends: dict[int, int] = {}
        for key, value in keys.items():
            node = 0
            for c in key:
                if c not in tree[node]:
                    tree[node][c] = len(tree)
                    tree.append({})
                node = tree[node][c]
            ends[node] = value
        free, queue = 1, [(0, 0)]
        for node, state in queue:
            children = sorted(tree[node])
            if not children:
                continue
            while free < len(self.check) and self.check[free] >= 0:
                free += 1
            at = start = max(free - children[0] - 1, 0)
            while any(at + c + 1 < len(self.check) and self.check[at + c + 1] >= 0 for c in children):
                at += 1
            free += (at - start) // 16  # gives up crowded room rather than search it again for every node
            self._grow(at + children[-1] + 2)
            self.base[state] = at
            for c in children:
                child = at + c + 1
                self.check[child] = state
                self.value[child] = ends.get(tree[node][c], -1)
                queue.append((tree[node][c], child))
        self._grow(max(self.base) + 258)

    def _grow(self, size: int) -> None:
        lack = size - len(self.check)
        if lack > 0:
            self.base += [0] * lack
            self.check += [-1] * lack
            self.value += [-1] * lack


def segmenter(pieces: list[str]) -> re.Pattern:
    """Cuts a text where no piece can go on, so that the best path of the text is that of its segments one after another: before a
    marker that follows something else, and around a line end. A vocabulary with pieces that do go on there is not cut at all."""
    if any(re.search("[^ ] ", p) or "\n" in p for p in pieces):
        return re.compile(r"(?s).+")
    return re.compile(r"\n| *[^ \n]+| +")


class Pieces:
    """Pieces of a vocabulary with log scores, encoder and decoder.

    ``scores`` "file" takes the scores of the file as log probabilities. A file made by merges has minus the rank there; "zipf"
    turns a rank into a log probability by Zipf's law, log(1 / (rank + 1) / H), which favours few and frequent pieces.
    """

    def __init__(self, path: str = MODEL, scores: str = "zipf"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        self.bytes_of: list[bytes] = []
        self.byte_ids = [-1] * 256
        keys: dict[bytes, int] = {}
        self.score = [0.0] * size
        plain: list[str] = []
        harmonic = math.log(sum(1.0 / (i + 1) for i in range(size)))
        for i in range(size):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                self.bytes_of.append(bytes([int(piece[3:5], 16)]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                self.bytes_of.append(b"")
            else:
                # Keys hold a blank for the marker: a marker that stands in a text itself goes through bytes and is not read back as a blank.
                keys[piece.replace(MARKER, " ").encode()] = i
                raw = model.get_score(i)
                self.score[i] = raw if scores == "file" else -math.log(1.0 - raw) - harmonic
                self.bytes_of.append(piece.replace(MARKER, " ").encode())
                plain.append(piece.replace(MARKER, " "))
        self.trie = DoubleArray(keys)
        self.unknown = min(self.score[i] for i in keys.values()) - UNKNOWN
        for i in self.byte_ids:
            self.score[i] = self.unknown
        self.scores = np.array(self.score)
        self.is_byte = np.zeros(size, bool)
        self.is_byte[self.byte_ids] = True
        self.segment = segmenter(plain)
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def best(self, segment: str) -> bytes:
        """Ids (as int32 bytes) of the best path by Viterbi; of equal paths the one found first."""
        base, check, value, score, unknown = self.trie.base, self.trie.check, self.trie.value, self.score, self.unknown
        raw = segment.encode()
        n = len(raw)
        best, start, last = [-math.inf] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
        best[0] = 0.0
        i = 0
        while i < n:
            here = best[i]
            lead = raw[i]
            step = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
            state, j, single = 0, i, False
            while j < n:
                child = base[state] + raw[j] + 1
                if check[child] != state:
                    break
                state = child
                j += 1
                piece = value[state]
                if piece >= 0:
                    single |= j == i + step
                    total = here + score[piece]
                    if total > best[j]:
                        best[j], start[j], last[j] = total, i, piece
            if not single and here + step * unknown > best[i + step]:
                best[i + step], start[i + step], last[i + step] = here + step * unknown, i, -1
            i += step
        path, j = [], n
        while j > 0:
            i = start[j]
            if last[j] >= 0:
                path.append(last[j])
            else:
                path += [self.byte_ids[c] for c in reversed(raw[i:j])]
            j = i
        path.reverse()
        return array("i", path).tobytes()

    def encode(self, text: str) -> np.ndarray:
        """Ids of a whole text, with one marker put before it; none for an empty text."""
        if not text:
            return np.zeros(0, np.int32)
        if len(self.cache) > CACHE:
            self.older, self.cache = self.cache, {}
        cache, older = self.cache, self.older
        parts = self.segment.findall(" " + text)
        long: dict[str, bytes] = {}
        for part in [p for p in parts if p not in cache]:
            if len(part) > LONG:
                if part not in long:
                    long[part] = self.best(part)
            elif part not in cache:
                cache[part] = older[part] if part in older else self.best(part)
        return np.frombuffer(b"".join([cache[p] if p in cache else long[p] for p in parts]), np.int32)

    def decode(self, ids) -> str:
        """Text of ids: bytes of all pieces joined, markers as blanks, without the one blank put before the text."""
        raw = b"".join(map(self.bytes_of.__getitem__, ids))
        return raw.decode("utf-8", "replace").removeprefix(" ")


def encode(documents: DataFrame, path: str = MODEL, scores: str = "zipf") -> DataFrame:
    """(doc_id, ids, n_pieces, n_bytes, log_score, decoded_same) for every row, whole texts, in no order.

    ``ids`` is the most probable segmentation; ``n_bytes`` of them are byte pieces; ``decoded_same`` says that decoding the ids gives
    the text again. A null text has null ids and decoded_same and zero counts; an empty text has no ids. Rows are kept as they are,
    repeated ones too; further columns are ignored. Nothing is shuffled; the vocabulary (fixed size) is broadcast once.
    """
    shorten_batches(documents.sparkSession)
    shared = documents.sparkSession.sparkContext.broadcast(Pieces(path, scores))

    def run(batches):
        pieces = shared.value
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                rows = []
                for text in part.column(1).to_pylist():
                    if text is None:
                        rows.append((None, 0, 0, 0.0, None))
                        continue
                    ids = pieces.encode(text)
                    rows.append((
                        ids, len(ids), int(pieces.is_byte[ids].sum()), float(pieces.scores[ids].sum()), pieces.decode(ids.tolist()) == text,
                    ))
                columns = list(zip(*rows))
                kinds = [pa.int64(), pa.int64(), pa.float64(), pa.bool_()]
                flat = [x for x in columns[0] if x is not None]
                ends = np.concatenate(([0], np.cumsum([0 if x is None else len(x) for x in columns[0]]))).astype(np.int32)
                ids = pa.ListArray.from_arrays(
                    pa.array(ends, pa.int32()), pa.array(np.concatenate(flat) if flat else np.zeros(0, np.int32)),
                    mask=pa.array([x is None for x in columns[0]]),
                )
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).cast(pa.int64()), ids, *(pa.array(c, k) for c, k in zip(columns[1:], kinds))],
                    ["doc_id", "ids", "n_pieces", "n_bytes", "log_score", "decoded_same"],
                )

    schema = "doc_id long, ids array<int>, n_pieces long, n_bytes long, log_score double, decoded_same boolean"
    return documents.select("doc_id", "text").mapInArrow(released(run), schema)


def decode(encoded: DataFrame, path: str = MODEL) -> DataFrame:
    """(doc_id, text) from (doc_id, ids); null ids give a null text."""
    shared = encoded.sparkSession.sparkContext.broadcast(Pieces(path))

    def run(batches):
        for batch in batches:
            texts = [None if x is None else shared.value.decode(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


@query("op3_sentencepiece")
def op3_sentencepiece(spark, sf_dir):
    return encode(read(spark, sf_dir, "documents"))
