"""Operator 12: the files against the tokenizer run on whole texts, and every operation of a file against the plain sequence."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tableworks.llm import queries, tokens, wavelet
from tableworks.llm.common import portions

PATH = public_tokenizers.path("word_bpe_49k.json")
SF = "/root/testdata/sf0.001"


def plain(rows):
    own = Tokenizer.from_file(PATH)
    out, start = [], 0
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = [*own.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def got(df):
    return sorted((tuple(r) for r in df.select("doc_id", "start", "n_tokens", "ids_crc32").collect()), key=lambda r: r[1])


def test_query_equals_whole_texts(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert got(queries.QUERIES["op12_token_files"](spark, SF)) == plain(rows)


ODD = ["".join(map(chr, range(128))), "a1b2,c.d's x=y_z {q}[w] <b>r</b> 3.14% ~~ `x` \\n",
       "", None, " \t\n", "It's I'LL we’re", "á ́b é", "x y z　w", "ΣΣΣ İstanbul ß", "\x00\x01 \x85q",
       "ไทยอักษร" * 40, "12345 1 22", "<|endoftext|> a<|startoftext|>b", "\U0001f600\U0001f468‍\U0001f469 ok"]


def test_odd_texts_repeated_rows_and_cut_documents(spark, tmp_path):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(3, "same"), (3, "same"), (3, None), (None, "no id"), (100, "word " * 700), (101, "tail")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("path", F.lit(1)).withColumn("a.b", F.lit(2))
    for shard in (64, 1000):
        files = tokens.write_tokens(df, PATH, str(tmp_path / str(shard)), shard=shard)
        assert got(tokens.read_tokens(files)) == plain(rows)
        assert max(r.n_tokens for r in files.collect()) <= shard
    assert got(tokens.read_tokens(tokens.write_tokens(df.limit(0), PATH, str(tmp_path / "none")))) == []


def test_pieces_of_a_long_text_give_the_ids_of_the_whole():
    rng = np.random.default_rng(1)
    words = [w for t in ODD if t for w in t.split()] + ["and", "THE", "of"]
    text = "".join(w + str(rng.choice([" ", "\n", "  ", "\t　"])) for w in rng.choice(words, 3000))
    parts = list(portions(text, tokens._BLANK, 500))
    assert b"".join(p for p, _ in parts).decode() == text and len(parts) > 20
    ids, counts = tokens.WordCoder(PATH).encode([p for p, _ in parts])
    assert ids.tolist() == Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids and counts.sum() == len(ids)


def test_every_pair_of_ascii_signs_in_a_word():
    own, whole = tokens.WordCoder(PATH), Tokenizer.from_file(PATH)
    assert own.by_model
    words = [f"q{chr(a)}{chr(b)}st" for a in range(128) for b in range(128)]
    ids, counts = own.encode([w.encode() for w in words])
    assert ids.tolist() == [i for w in words for i in whole.encode(w, add_special_tokens=False).ids]


def test_kept_words_stay_bounded(monkeypatch):
    monkeypatch.setattr(tokens, "KEPT", 8000)
    own, whole = tokens.WordCoder(PATH), Tokenizer.from_file(PATH)
    rng = np.random.default_rng(2)
    for _ in range(20):
        texts = ["".join(chr(97 + c) for c in rng.integers(0, 26, 200)) + " " + " ".join(str(x) for x in rng.integers(0, 999, 30)) for _ in range(4)]
        ids, counts = own.encode([t.encode() for t in texts])
        assert ids.tolist() == [i for t in texts for i in whole.encode(t, add_special_tokens=False).ids]
        assert sum(len(w) for w in own.words.to_pylist()) < 8000 and max(map(len, own.words.to_pylist()), default=0) <= tokens.LONG


@pytest.mark.parametrize("n, top", [(0, 5), (1, 1), (7, 2), (5000, 49408), (3000, 70000), (4096, 1)])
def test_file_operations(tmp_path, monkeypatch, n, top):
    monkeypatch.setattr(wavelet, "BLOCK", 512)
    rng = np.random.default_rng(n)
    ids = np.minimum(rng.zipf(1.3, n), top).astype(np.uint32)
    path = str(tmp_path / "x.wm")
    wavelet.write(path, ids, [4, None], [n // 2, n], 3, False)
    with wavelet.Sequence(path) as seq:
        assert len(seq) == n and seq.doc_ids == [4, None] and seq.ends.tolist() == [n // 2, n] and seq.before == 3 and not seq.closed
        assert seq.all().tolist() == ids.tolist()
        at = rng.integers(0, max(n, 1), 50 if n else 0)
        assert seq.tokens(at).tolist() == ids[at].tolist()
        for token in [*np.unique(ids)[:20].tolist(), 0, 3, 10**6]:
            lo, hi = sorted(rng.integers(0, n + 1, 2).tolist())
            assert seq.count(token) == (ids == token).sum() and seq.count(token, lo, hi) == (ids[lo:hi] == token).sum()
            assert seq.occurrences(token).tolist() == np.flatnonzero(ids == token).tolist()
            assert seq.occurrences(token, lo, hi).tolist() == (lo + np.flatnonzero(ids[lo:hi] == token)).tolist()
