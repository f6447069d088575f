"""MinHash near-dedup, passage dedup, embedding near-dedup and components against brute force."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tableworks.llm import graph, hamming, minhash, nearpairs, passages, vectors
from tableworks.llm.common import Words, counted, shingles

DOC = "doc_id long, text string, lang string, class_id string, digest string, keys string"


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(n))


def edited(rng, text, k):
    words = text.split()
    for i in rng.sample(range(len(words)), k):
        words[i] = "x" + words[i]
    return " ".join(words)


def items(texts):
    w = Words([t.lower().encode() for t in texts])
    h, owner, weight = counted(*shingles(w.hash, w.starts))
    cut = np.searchsorted(owner, np.arange(len(texts) + 1))
    return [(h[a:b], weight[a:b]) for a, b in zip(cut[:-1], cut[1:])]


def smallest(n, links):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def probability_jaccard(a, b):
    """The definition, term by term."""
    x, y = (dict(zip(s[0].tolist(), s[1].tolist())) for s in (a, b))
    total = 0.0
    for d in x.keys() & y.keys():
        total += 1 / sum(max(x.get(e, 0) / x[d], y.get(e, 0) / y[d]) for e in x.keys() | y.keys())
    return total


def test_probability_jaccard_is_its_definition_and_registers_estimate_it():
    rng = random.Random(1)
    base = prose(rng, 60)
    texts = [base + " " + " ".join(base.split()[:30]) * k for k in range(3)] + [edited(rng, base, 3), prose(rng, 40)]
    sets = items(texts)
    for a in sets:
        for b in sets:
            assert nearpairs.similarity(a, b, True) == pytest.approx(probability_jaccard(a, b))
    w = Words([t.lower().encode() for t in texts])
    found = minhash.prob_min_hash(*counted(*shingles(w.hash, w.starts)), len(texts), m=4000)
    for i in range(len(texts)):
        for j in range(i):
            assert (found[i] == found[j]).mean() == pytest.approx(nearpairs.similarity(sets[i], sets[j], True), abs=0.05)


def test_near_documents_like_brute_force(spark):
    rng = random.Random(2)
    bases = [prose(rng, n) for n in (30, 60, 120, 300)]
    texts = []
    for base in bases:
        for k in (0, 0, 1, 2, 3, 5, 8, 13):
            texts.append(edited(rng, base, min(k, len(base.split()) // 3)))
    chain = bases[2]
    for _ in range(30):
        chain = edited(rng, chain, 2)
        texts.append(chain)
    texts += ["", " \n ", "...", "one", "one", "two words", "Two, words."]
    rows = [(i, t, "en", "x", "y", "z") for i, t in enumerate(texts)] + [(900, None, None, None, None, None), (None, "one", None, None, None, None)]
    got = {r["doc_id"]: r for r in minhash.near_duplicates(spark.createDataFrame(rows, DOC)).collect()}
    sets = items(texts)
    links = [(i, j) for i in range(len(texts)) for j in range(i) if len(sets[i][0]) and len(sets[j][0]) and probability_jaccard(sets[i], sets[j]) >= 0.8]
    want = smallest(len(texts), links)
    assert [got[i]["component_id"] for i in range(len(texts))] == want
    assert [got[i]["kept"] for i in range(len(texts))] == [i == c for i, c in enumerate(want)]
    assert got[900]["kept"] and got[900]["class_id"] == 900 and got[None]["kept"] and got[None]["component_id"] is None


@pytest.mark.parametrize("limits", [{}, {"FAMILY": 3, "BLOCK": 40, "MEMBERS": 30}])
def test_groups_of_any_size_give_the_same(spark, monkeypatch, limits):
    """Whole families in one task, or cut to centres and blocks: the components are those of all pairs."""
    for name, value in limits.items():
        monkeypatch.setattr(nearpairs, name, value)
    rng = random.Random(3)
    texts = []
    for size, edits, length in ((120, 2, 100), (60, 6, 100), (60, 9, 120), (5, 3, 80)):
        base = prose(rng, length) + " same words come again and again" * 3
        texts += [edited(rng, base, rng.randint(0, edits)) for _ in range(size)]
    texts += [texts[0]] * 200
    got = {r["doc_id"]: r for r in minhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    sets = items(texts)
    links = [(i, j) for i in range(245) for j in range(i) if nearpairs.similarity(sets[i], sets[j], True) >= 0.8] + [(0, i) for i in range(245, len(texts))]
    want = smallest(len(texts), links)
    assert [got[i]["component_id"] for i in range(len(texts))] == want


def test_bounds_are_never_below_the_similarity():
    rng = random.Random(9)
    base = prose(rng, 60)
    texts = [edited(rng, base, rng.randint(0, 20)) + " " + " ".join(base.split()[: rng.randint(0, 40)]) * rng.randint(0, 3) for _ in range(25)]
    sets = items(texts)
    for weighted in (True, False):
        bound = nearpairs._bounds(sets, sets, weighted)
        for i in range(25):
            for j in range(25):
                exact = nearpairs.similarity(sets[i], sets[j], weighted)
                assert bound[i, j] >= exact - 1e-5
                if not weighted:
                    assert bound[i, j] == pytest.approx(exact, abs=1e-5)


def test_repeated_rows_and_columns_stay_whole(spark):
    rows = [(1, "a b c d e f g", "x"), (1, "a b c d e f g", "x"), (2, "A b, c d e f g.", "y"), (3, None, "z"), (None, "a b c d e f g", "w")]
    df = spark.createDataFrame(rows, "doc_id long, text string, keys string")
    kept = minhash.deduplicated(df)
    assert kept.columns == df.columns
    assert sorted((r["doc_id"] or 0, r["keys"]) for r in kept.collect()) == [(0, "w"), (1, "x"), (3, "z")]
    assert minhash.deduplicated(df.limit(0)).count() == 0


def test_components_of_chains_stars_and_nulls(spark):
    links = [(i, i + 1) for i in range(50)] + [(100, 100 + i) for i in range(1, 40)] + [(300 - i, 300) for i in range(1, 20)] + [(7, 7), (None, 3)]
    got = {r["id"]: r["component"] for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(51)}, **{i: 100 for i in range(100, 140)}, **{i: 281 for i in range(281, 301)}}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def sentences(rng, n):
    out = []
    while sum(len(s.split()) for s in out) < n:
        out.append(prose(rng, rng.randint(4, 9)).capitalize() + ".")
    return " ".join(out)


def test_passages_are_found_whole_within_and_nearly(spark):
    rng = random.Random(4)
    shared, inside = sentences(rng, 60), sentences(rng, 70)
    texts = [
        sentences(rng, 50) + "\n" + shared, sentences(rng, 30) + "\n" + shared.upper() + "\n" + sentences(rng, 80), edited(rng, shared, 1),
        prose(rng, 25) + " " + inside + " " + prose(rng, 40), "Éé " + prose(rng, 60) + " " + inside, sentences(rng, 200), sentences(rng, 30), sentences(rng, 10),
        sentences(rng, 10), "", None,
    ]
    texts.append(texts[6] + "\n" + texts[6])
    df = spark.createDataFrame([(i, t, len(t or "")) for i, t in enumerate(texts)] + [(None, shared, 1), (1, texts[1], 1)], "doc_id long, text string, n_chars long")
    rows = passages.repeated(df).collect()
    spans = {(r["doc_id"], r["keeper_doc_id"]): texts[r["doc_id"]][r["start"] : r["end"]] for r in rows}
    assert {k for k in spans if k[0] != k[1]} == {(1, 0), (2, 0), (4, 3)}
    assert spans[1, 0] == shared.upper() and spans[2, 0] == texts[2]
    assert len(spans[4, 3]) >= 0.85 * len(inside) and spans[4, 3] in inside
    assert all(r["removed"] == (r["doc_id"] != r["keeper_doc_id"]) for r in rows)
    out = {r["doc_id"]: r for r in passages.deduplicated(df.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])).collect()}
    assert set(out) == set(range(len(texts))) - {2}
    assert out[1]["text"] == texts[1].replace(shared.upper() + "\n", "") and out[1]["n_chars"] == len(out[1]["text"])
    assert all(out[i]["text"] == texts[i] for i in (0, 3, 5, 6, 7, 8, 9, 10, 11))


def test_passage_banding_is_tuned_for_recall():
    for threshold in (0.5, 0.7, 0.8, 0.9):
        bands, rows = passages.banding(threshold)
        assert bands * rows <= passages.HASHES and (1 - threshold**rows) ** bands <= passages.MISS
    assert passages.repeated is not None


def unit(rng, n, d):
    x = rng.normal(size=(n, d))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def test_near_vectors_like_brute_force(spark):
    rng = np.random.default_rng(5)
    rows = []
    for label in (1, 2, None):
        base = unit(rng, 40, 64)
        for i, b in enumerate(base):
            for noise in (0, 0, 0.01, 0.02, 0.024, 0.03)[: 2 + i % 5]:
                rows.append((len(rows), [float(v) for v in np.float32(b + noise * rng.normal(size=64))], label))
    rows += [(900, None, 1), (901, [0.0] * 64, 1), (902, [float("nan")] * 64, 1), (903, [None] * 64, 1), (904, [], 1), (905, [1.0, 2.0], 1), (906, [2.0, 4.0], 1), (None, rows[0][1], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {r["vec_id"]: r for r in vectors.near_duplicates(df).collect()}
    x = [np.array(r[1], float) / np.linalg.norm(np.array(r[1], float)) if r[1] and None not in r[1] and np.isfinite(r[1]).all() and any(r[1]) else None for r in rows]
    ids = [r[0] for r in rows[:-1]]
    links = [
        (i, j) for i in range(len(ids)) for j in range(i)
        if x[i] is not None and x[j] is not None and rows[i][2] is not None and rows[i][2] == rows[j][2] and len(x[i]) == len(x[j]) and float(x[i] @ x[j]) >= 0.98
    ]
    want = smallest(len(ids), links)
    counts = [sum(i in pair for pair in links) for i in range(len(ids))]
    assert len(links) > 80 and [got[i]["n_links"] for i in ids] == counts
    assert [got[i]["component_id"] for i in ids] == [ids[c] for c in want]
    assert [got[i]["kept"] for i in ids] == [i == ids[c] for i, c in zip(ids, want)]
    assert got[None]["n_links"] == 0 and not got[None]["kept"]
    assert vectors.near_duplicates(df.limit(0)).count() == 0


def test_vector_recall_in_a_large_group_with_small_buckets(spark, monkeypatch):
    rng = np.random.default_rng(6)
    base = unit(rng, 1, 64)[0]
    x = np.concatenate((base + 0.012 * rng.normal(size=(500, 64)), unit(rng, 300, 64)))
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    monkeypatch.setattr(vectors, "BUCKET", 50)
    got = {r["vec_id"]: r["n_links"] for r in vectors.near_duplicates(df).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = (u @ u.T >= 0.98).sum(axis=1) - 1
    assert all(got[i] <= n for i, n in enumerate(want))
    assert sum(got.values()) >= 0.99 * want.sum()


def test_hamming_top_k_like_brute_force(spark):
    rng = np.random.default_rng(7)
    x = np.concatenate((rng.normal(size=(300, 40)), np.repeat(rng.normal(size=(1, 40)), 60, axis=0)))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000, None), (1001, [float("inf")] * 40), (1002, [1.0] * 3), (None, [1.0] * 40), (0, x[0].tolist())]
    codes = hamming.sign_codes(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    for blocks in ({}, {"index_block": 64, "query_block": 8}):
        got = hamming.top_k(codes, codes.where("id % 20 = 0"), 7, **blocks).collect()
        found = {}
        for r in sorted(got, key=lambda r: (r["query_id"], r["rank"])):
            found.setdefault(r["query_id"], []).append((r["distance"], r["id"]))
        bits = x >= 0
        want = {q: sorted((int((bits[q] != bits[i]).sum()), i) for i in range(len(x)) if i != q)[:7] for q in range(0, len(x), 20)}
        assert found == want
    assert hamming.top_k(codes.limit(0), codes, 3).count() == 0


def test_hamming_search_proves_its_radius():
    rng = np.random.default_rng(8)
    codes = rng.integers(0, 256, size=(2000, 8), dtype=np.uint8)
    tables = hamming.Segments(codes, 64)
    for q in range(20):
        code = codes[q].copy()
        code[0] ^= 3
        rows, distance = tables.nearest(code, 5, np.ones(len(codes), np.int64))
        true = np.bitwise_count(codes ^ code).sum(axis=1)
        assert sorted(distance.tolist())[:5] == sorted(true.tolist())[:5] and len(rows) < len(codes)


def test_no_local_checkpoint_and_components_written(spark):
    df = spark.range(5).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert "LocalCheckpoint" not in graph.components(df)._jdf.queryExecution().toString()


def planted_passages(rng):
    """Documents with shared runs of 51 words: bare, mid-clause, over short lines, wrapped otherwise; of 40 and 39 words; of pieces."""
    bare, middle, lines, forty, less = (prose(rng, n).split() for n in (51, 51, 51, 40, 39))
    long = sentences(rng, 200).split()

    def wrapped(words, n):
        return "\n".join(" ".join(words[i : i + n]) for i in range(0, len(words), n))

    def around(text):
        return f"{prose(rng, rng.randint(5, 90))} {text} {prose(rng, rng.randint(5, 90))}"

    clause = " ".join(["so", *middle[:20]]) + ", " + " ".join(middle[20:])
    texts = [
        around(" ".join(bare)), around(" ".join(bare).upper()), around(clause), around(clause + " and so on."), around(wrapped(lines, 17)), around(wrapped(lines, 9)),
        around(" ".join(forty)), "Ünï " + around("\n\n".join(forty)), around(" ".join(less)), around(" ".join(less)),
        around(" ".join(long[:120])), around(" ".join(long[60:])), around(" ".join(long[30:100])), "a " * 90, "a a\n" * 60, "", "a b c",
    ]
    return texts


def spots(text):
    return [(m.start(), m.end(), re.sub(r"[^\w]", "", m.group().lower())) for m in re.finditer(r"\S+", text)]


def windows(text, n=40):
    words = spots(text)
    return [(tuple(x[2] for x in words[k : k + n]), words[k][0], words[k + n - 1][1]) for k in range(len(words) - n + 1)]


def test_every_shared_run_of_words_is_found_in_its_full_span(spark):
    """Against a plain count of all runs of 40 words: the first document that has one keeps it, the others lose what they keep no run of."""
    rng = random.Random(11)
    texts = planted_passages(rng) + [sentences(rng, 120) for _ in range(20)]
    plain, where, protected = {}, {}, {}
    for i, text in enumerate(texts):
        for run, a, b in windows(text):
            plain.setdefault(run, []).append((i, a, b))
    for hits in plain.values():
        keeper = min(h[0] for h in hits)
        if keeper != max(h[0] for h in hits):
            for i, a, b in hits:
                (protected if i == keeper else where).setdefault((i, keeper), set()).update(range(a, b))
    where = {k: v - protected.get((k[0], k[0]), set()) for k, v in where.items()}
    rows = passages.repeated(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)).collect()
    got, stays = {}, {}
    for r in rows:
        (got if r["removed"] else stays).setdefault((r["doc_id"], r["keeper_doc_id"]), set()).update(range(r["start"], r["end"]))
    assert {k[0] for k in where} == {1, 3, 5, 7, 11, 12, 14}
    assert got == {k: v for k, v in where.items() if v}
    assert stays == protected


def lost(before, after):
    """Runs of 40 words that two documents had, within a line, and none has any more. Of a run over lines, each may stay elsewhere."""
    had = {}
    for i, text in before:
        for run, a, b in windows(text):
            if "\n" not in text[a:b]:
                had.setdefault(run, set()).add(i)
    has = {run for _, text in after for run, *_ in windows(text)}
    return {run: ids for run, ids in had.items() if len(ids) > 1 and run not in has}


def test_a_run_whose_first_holder_goes_as_a_near_copy_stays_elsewhere(spark):
    rng = random.Random(12)
    p, run = prose(rng, 300), prose(rng, 45)
    rows = [(1, p), (2, p + " " + run), (3, prose(rng, 30) + "\n" + prose(rng, 20) + " " + run + " " + prose(rng, 20))]
    out = [tuple(r) for r in passages.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(out) == [rows[0], rows[2]] and lost(rows, out) == {}


def test_chains_of_runs_lose_no_text(spark):
    rng = random.Random(13)
    stock = [prose(rng, rng.randint(15, 60)) for _ in range(12)]
    rows = []
    for i in range(60):
        parts = [rng.choice(stock) if rng.random() < 0.7 else prose(rng, rng.randint(3, 30)) for _ in range(rng.randint(1, 6))]
        rows.append((rng.randint(0, 45), (" " if rng.random() < 0.7 else "\n").join(parts)))
    rows += rows[:5]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    out = [tuple(r) for r in passages.deduplicated(df, threshold=1.0).collect()]  # without near-copies, which may replace a run
    gone = lost({(f"{i} {t}", t) for i, t in rows}, out)
    touched = [w for _, t in out for w in [x[2] for x in spots(t)]]
    assert set(x[2] for _, t in rows for x in spots(t)) == set(touched)
    copies = Counter(t for _, t in set(rows))
    assert all(all(copies[i.split(" ", 1)[1]] > 1 for i in ids) for ids in gone.values())
    assert sum(len(t) for _, t in out) < sum(len(t) for _, t in rows)
    assert len(lost({(f"{i} {t}", t) for i, t in out}, out)) == 0


def test_rows_of_one_doc_id_with_other_texts_are_cut_each_at_its_own_place(spark):
    rng = random.Random(14)
    p, x, y, z = (prose(rng, n) for n in (60, 30, 125, 70))
    rows = [(1, p), (2, p + "\n" + x), (2, y + "\n" + p + "\n" + z), (3, p), (3, p), (4, "short text"), (5, "short text")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("a.b", F.lit(1)).withColumn("marks", F.lit(2))
    out = passages.deduplicated(df)
    assert out.columns == df.columns
    assert sorted((r[0], r[1]) for r in out.collect()) == sorted([(1, p), (2, x), (2, y + "\n" + z), (4, "short text"), (5, "short text")])
    spans = {(r["doc_id"], r["start"], r["end"], r["removed"]) for r in passages.repeated(df).collect()}
    assert spans == {(1, 0, len(p), False), (2, 0, len(p), True), (2, len(y) + 1, len(y) + 1 + len(p), True), (3, 0, len(p), True)}


def test_intervals_against_sets():
    rng = np.random.default_rng(15)
    for _ in range(200):
        a, n = rng.integers(0, 40, 8), rng.integers(1, 9, 8)
        s, e, own = passages.merged(a, a + n)
        points = set().union(*(range(x, y) for x, y in zip(a, a + n)))
        assert set().union(*(range(x, y) for x, y in zip(s, e))) == points and (s[1:] > e[:-1]).all()
        assert all(s[o] <= x and x + m <= e[o] for x, m, o in zip(a, n, own))
        off, on, _ = passages.merged(*(lambda q: (q, q + 3))(rng.integers(0, 45, int(rng.integers(0, 5)))))
        left, right, piece = passages.without(s, e, off, on)
        assert set().union(*(range(x, y) for x, y in zip(left, right))) == points - set().union(*(range(x, y) for x, y in zip(off, on)))
        assert all(s[p] <= x < y <= e[p] for x, y, p in zip(left, right, piece))


def test_the_session_keeps_its_batch_size(spark):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    df = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    passages.repeated(df).count(), minhash.near_duplicates(df).count()
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before
