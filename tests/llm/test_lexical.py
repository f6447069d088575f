"""Operator 13 against a plain ranking in Python."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tableworks.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(docs, items, top=10):
    bags = [(d, Counter(TERM.findall((t or "").translate(LOWER)))) for d, t in docs]
    bags = [(d, b, b.total()) for d, b in bags if b]
    total, length = len(bags), sum(n for *_, n in bags)
    df = Counter(t for _, b, _ in bags for t in b)
    out = []
    for item, text in items:
        scores = []
        for d, b, n in bags:
            m = 100 - 75 + (75 * n * total) // length
            s = sum(
                times * math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * (10**9 * b[t] // (1000 * b[t] + 8 * m))
                for t, times in Counter(TERM.findall((text or "").translate(LOWER))).items() if t in b
            )
            if s > 0:
                scores.append((-s, d is None, d or 0, d))
        out += [(item, k + 1, d, -s) for k, (s, _, _, d) in enumerate(sorted(scores, key=lambda x: x[:3])[:top])]
    return sorted(out, key=str)


def got(df):
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect()), key=str)


def words(rng, n):
    return " ".join(f"w{min(int(x), 400)}" for x in rng.zipf(1.4, n))


@pytest.mark.parametrize("block", [4, 4096])
def test_equals_the_plain_ranking(spark, monkeypatch, block):
    rng = np.random.default_rng(block)
    monkeypatch.setattr(lexical, "BLOCK", block)
    monkeypatch.setattr(lexical, "SLICE", 300)
    docs = [(i, words(rng, int(rng.integers(0, 60)))) for i in range(120)] + [(500 + i, "w1 same w9 copy") for i in range(40)]
    docs += [(900, None), (901, ""), (902, " .,!"), (903, "É w2-W2_w2 ſK İ"), (904, words(rng, 2000)), (5, "w3 w3"), (5, "w3 w3"), (None, "w77 w2 rare")]
    items = [(1, "w1 w2 w2 W3"), (2, "copy same"), (3, None), (4, "... "), (5, "absent"), (6, "É rare k K"), (6, "w9"), (None, "w5 w6 w7 w8")]
    items += [(10 + i, words(rng, 12)) for i in range(12)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit(0)).withColumn("a.b", F.lit(1)).repartition(3)
    asked = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(0)).withColumn("score", F.lit(1))
    assert got(lexical.ranked_search(frame, asked)) == plain(docs, items)


def test_rounds_bundles_and_empty_tables(spark, monkeypatch):
    rng = np.random.default_rng(3)
    docs = [(i, words(rng, 30)) for i in range(80)]
    items = [(i, words(rng, 8)) for i in range(30)]
    frame, asked = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(lexical, "TERMS", 60)
    monkeypatch.setattr(lexical, "BUNDLE", 3)
    monkeypatch.setattr(lexical, "POSTINGS", 50)
    assert got(lexical.ranked_search(frame, asked, top=3)) == plain(docs, items, 3)
    assert got(lexical.ranked_search(frame.limit(0), asked)) == [] == got(lexical.ranked_search(frame, asked.limit(0)))
