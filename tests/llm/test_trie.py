"""Operator 11 against a plain trie of whole conversations."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tableworks.llm import trie


def plain(rows):
    """rows: (conv_id, turn, role, text), without equal (conv_id, turn)."""
    own = defaultdict(list)
    for c, turn, role, text in sorted(rows, key=lambda r: (r[0] or 0, r[1] is not None, r[1] or 0)):
        if c is not None:
            own[c].append((role or "", text or ""))
    whole = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        donor = int(c / 20) * 20
        whole[c] = [*own.get(donor, [])[:h], *turns[h:]]
    members = defaultdict(list)
    for c in sorted(whole):
        for d in range(len(whole[c]) + 1):
            members[tuple(whole[c][:d])].append(c)
    kids = defaultdict(int)
    for path in members:
        if path:
            kids[path[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for path, convs in members.items():
        worth = (len(convs) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", path[-1][1])) if path else 0
        for d in range(len(path) + 1):
            leaves[path[:d]] += not kids[path]
            saved[path[:d]] += worth
    return sorted(
        (convs[0], len(path), members[path[:-1]][0] if path else None, len(convs), kids[path], leaves[path], saved[path],
         hashlib.sha256(",".join(str(c) for c in convs if len(whole[c]) == len(path)).encode()).hexdigest())
        for path, convs in members.items()
    )


def got(df):
    return sorted(
        tuple(r) for r in df.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()
    )


def frame(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    return df.withColumn("key", F.lit(1)).withColumn("a.b", F.lit(2)).withColumn("depth", F.lit("x")).repartition(3)


def chats(seed, n=150, longest=9, kinds=3):
    rng = random.Random(seed)
    rows = []
    for c in range(-30, n):
        for t in range(rng.randint(1, longest)):
            rows.append((c, t if t else rng.choice([0, None]), rng.choice(["user", None]), rng.choice(["", None, "a b", "c\td  e", "ü"][:kinds])))
    return rows


@pytest.mark.parametrize("slab, chunk", [(64, 100_000), (4, 40), (2, 7), (3, 1)])
def test_equals_a_plain_trie(spark, monkeypatch, slab, chunk):
    monkeypatch.setattr(trie, "SLAB", slab)
    monkeypatch.setattr(trie, "CHUNK", chunk)
    rows = chats(slab)
    assert got(trie.conversation_trie(frame(spark, rows))) == plain(rows)


@pytest.mark.parametrize("slab, chunk", [(64, 50), (5, 13)])
def test_hot_turns_copies_and_a_long_conversation(spark, monkeypatch, slab, chunk):
    monkeypatch.setattr(trie, "SLAB", slab)
    monkeypatch.setattr(trie, "CHUNK", chunk)
    rows = [(c, t, "user", f"same {t}") for c in range(200) for t in range(5)]  # copies
    rows += [(c, t, "user", "hot" if t == 0 else f"{c} {t}") for c in range(300, 400) for t in range(3)]
    rows += [(c, t, "x", "long one") for c in (500, 501, 507) for t in range(37 if c == 501 else 40)]
    rows += [(600, 0, "a", "only the donor"), (None, 0, "user", "none"), (None, 1, "user", "none")]
    assert got(trie.conversation_trie(frame(spark, rows))) == plain(rows)


def test_edges(spark):
    assert got(trie.conversation_trie(frame(spark, chats(1)).limit(0))) == []
    empty = hashlib.sha256(b"").hexdigest()
    c = next(i for i in range(1, 20) if zlib.crc32(str(i).encode()) % 4 == 3)
    df = frame(spark, [(c, 0, "user", "gone"), (c, 0, "user", "gone")])  # no donor, all own turns cut: a turnless conversation
    assert got(trie.conversation_trie(df)) == [(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]
    df = frame(spark, [(20, 0, "user", "tie b"), (20, 0, "user", "tie a"), (20, 0, "user", "tie a")])
    again = frame(spark, [(20, 0, "user", "tie a"), (20, 0, "user", "tie b"), (20, 0, "user", "tie a")])
    assert got(trie.conversation_trie(df)) == got(trie.conversation_trie(again)) and len(got(trie.conversation_trie(df))) == 4
    assert [r[-1] for r in got(trie.conversation_trie(df))][:3] == [empty] * 3


def test_medians_cover_and_halve():
    for n in (0, 1, 2, 7, 100):
        assert sorted(trie.medians(n)) == list(range(n))
    tree = trie.Tree()
    for k in trie.medians(1023):
        tree.insert([k], [1])

    def height(node):
        return 0 if node < 0 else 1 + max(height(tree.less[node]), height(tree.more[node]))

    assert height(tree.down[0]) == 10
