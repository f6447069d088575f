import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tableworks.functions.splitting import split_recursive
from tableworks.operators import retrieval as R
from tableworks.operators import search as S


@pytest.fixture(scope="module")
def points():
    rng = np.random.default_rng(5)
    m = rng.normal(size=(300, 8)).round(3)
    m[100:200] = m[100]  # a third of all vectors are copies of one
    return m


def brute(points, metric, k):
    out = {}
    for i, q in enumerate(points):
        if metric == "cosine":
            s = points @ q / np.linalg.norm(points, axis=1) / np.linalg.norm(q)
        elif metric == "l2":
            s = -((points - q) ** 2).sum(1)
        else:
            s = points @ q
        order = sorted(range(len(points)), key=lambda j: (-round(float(s[j]), 9), j))
        out[i] = order[:k]
    return out


@pytest.mark.parametrize("metric", ["ip", "cosine", "l2"])
@pytest.mark.parametrize("broadcast", [None, False])
def test_exact_search(spark, points, metric, broadcast):
    df = spark.createDataFrame([(i, [float(x) for x in p]) for i, p in enumerate(points)], "id BIGINT, embedding ARRAY<DOUBLE>").repartition(5)
    out = S.knn_topk(df, df, k=4, metric=metric, query_id="id", broadcast=broadcast, block_rows=70).collect()
    want = brute(points, metric, 4)
    got = {}
    for r in sorted(out, key=lambda r: r.rank):
        got.setdefault(r.query_id, []).append(r.id)
    assert got == want


def test_self_is_left_out_on_request(spark, points):
    df = spark.createDataFrame([(i, [float(x) for x in p]) for i, p in enumerate(points)], "id BIGINT, embedding ARRAY<DOUBLE>")
    out = S.knn_topk(df, df, k=3, metric="l2", query_id="id", exclude_self=True)
    assert out.where("query_id = id").count() == 0 and out.count() == 900


def test_lsh_finds_most_neighbours_and_spreads_a_hot_bucket(spark, points):
    df = spark.createDataFrame([(i, [float(x) for x in p]) for i, p in enumerate(points)], "id BIGINT, embedding ARRAY<DOUBLE>")
    exact = {(r.query_id, r.id) for r in S.knn_topk(df, df, k=4, metric="cosine", query_id="id").collect()}
    near = {(r.query_id, r.id) for r in S.knn_lsh(df, df, k=4, metric="cosine", query_id="id", dim=8, block_rows=40).collect()}
    assert len(exact & near) / len(exact) > 0.8


@pytest.mark.parametrize("groups", [1 << 20, 0])
def test_lsh_gives_the_best_of_all_buckets_probed_and_sends_vectors_once(spark, monkeypatch, groups):
    monkeypatch.setattr(S, "BROADCAST_GROUPS", groups, raising=False)
    sent, broadcast = [], S.F.broadcast
    monkeypatch.setattr(S.F, "broadcast", lambda df: (sent.append(df.columns), broadcast(df))[1])
    rng = np.random.default_rng(9)
    m, tables, bits, dim = rng.standard_normal((300, 6)).round(3), 3, 6, 6
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "id long, embedding array<double>")
    out = S.knn_lsh(df, df, k=3, metric="cosine", query_id="id", dim=dim, bits=bits, tables=tables, block_rows=50)
    got = sorted((r.query_id, r.rank, r.id) for r in out.collect())
    planes = np.random.default_rng(42).standard_normal((tables, bits, dim + 2))
    codes = [(m @ planes[t][:, :dim].T > 0) @ (1 << np.arange(bits)) for t in range(tables)]
    scores = np.round((m / np.linalg.norm(m, axis=1, keepdims=True)) @ (m / np.linalg.norm(m, axis=1, keepdims=True)).T, 9)
    want = []
    for i in range(len(m)):
        seen = sorted({j for c in codes for j in range(len(m)) if int(c[i] ^ c[j]).bit_count() <= 1}, key=lambda j: (-scores[i, j], j))
        if len(seen) < 3:
            seen = sorted(range(len(m)), key=lambda j: (-scores[i, j], j))
        want += [(i, r + 1, j) for r, j in enumerate(seen[:3])]
    assert got == want
    assert len(sent) == (1 if groups else 0)


def test_lsh_with_rows_that_come_twice(spark):
    rng = np.random.default_rng(9)
    m, tables, bits, k = rng.standard_normal((150, 6)).round(3), 3, 4, 4
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)] * 2, "id long, embedding array<double>")
    got = {}
    for r in S.knn_lsh(df, df, k=k, metric="cosine", query_id="id", dim=6, bits=bits, tables=tables).collect():
        got.setdefault(r.query_id, set()).add((r.rank, r.id))
    planes = np.random.default_rng(42).standard_normal((tables, bits, 8))
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    scores, checked = np.round(unit @ unit.T, 9), 0
    for i in range(len(m)):
        found = set()
        for t in range(tables):
            codes = (m @ planes[t][:, :6].T > 0) @ (1 << np.arange(bits))
            for probe in [codes[i], *(codes[i] ^ (1 << np.arange(bits)))]:
                bucket = sorted((j for j in np.flatnonzero(codes == probe).tolist() for _ in range(2)), key=lambda j: (-scores[i, j], j))
                found |= set(bucket[:k])
        if len(found) >= k:
            checked += 1
            assert got[i] == {(r + 1, j) for r, j in enumerate(sorted(found, key=lambda j: (-scores[i, j], j))[:k])}
    assert checked > 100


@pytest.mark.parametrize("metric", ["cosine", "ip", "l2"])
def test_lsh_recall_with_64_dimensions(spark, metric):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 64)) * rng.uniform(0.8, 1.2, size=(3000, 1)) + np.repeat(rng.normal(size=(30, 64)), 100, axis=0)
    df = spark.createDataFrame([(i, [float(v) for v in p]) for i, p in enumerate(x)], "id BIGINT, embedding ARRAY<DOUBLE>")
    queries = df.where("id % 10 = 0")
    exact = {(r.query_id, r.id) for r in S.knn_topk(queries, df, metric=metric, query_id="id").collect()}
    near = [(r.query_id, r.id) for r in S.knn_lsh(queries, df, metric=metric, query_id="id", dim=64, block_rows=100).collect()]
    assert len(near) == len(set(near)) == 6 * 300
    assert len(exact & set(near)) / len(exact) >= 0.9


def test_lsh_answers_every_query_and_filters(spark):
    df = spark.createDataFrame([(i, [float(i % 7), 1.0, float(-i)], i % 3) for i in range(60)], "id BIGINT, embedding ARRAY<DOUBLE>, part INT")
    got = S.knn_lsh(df, df, k=5, query_id="id", dim=3, bits=12, tables=1, where="part = 1").collect()
    assert len(got) == 60 * 5 and all(r.id % 3 == 1 for r in got)
    exact = S.knn_topk(df, df, k=5, query_id="id", where=F.col("part") == 1).collect()
    assert all(r.id % 3 == 1 for r in exact)


def test_texts_are_not_shuffled_to_find_the_hits(spark, monkeypatch):
    docs = spark.range(100).select("id", F.format_string("text %d", "id").alias("text"))
    hits = spark.createDataFrame([(1, i, i) for i in (3, 7)], "query_id INT, id BIGINT, rank INT")
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = R.lookup_payload(hits, docs)
        assert "Exchange hashpartitioning" not in found._jdf.queryExecution().toString()
        assert sorted(map(tuple, found.collect())) == [(3, 1, 3, "text 3"), (7, 1, 7, "text 7")]
        monkeypatch.setattr(R, "BROADCAST_HITS", 1)
        assert sorted(map(tuple, R.lookup_payload(hits, docs).collect())) == [(3, 1, 3, "text 3"), (7, 1, 7, "text 7")]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)


def test_bad_vectors_stop_the_search(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0])], "id BIGINT, embedding ARRAY<DOUBLE>")
    with pytest.raises(Exception, match="different length"):
        S.knn_topk(df, df, query_id="id").collect()


def test_scorer_sees_only_what_the_search_kept(spark):
    vectors = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(50)], "id BIGINT, embedding ARRAY<DOUBLE>")
    docs = spark.createDataFrame([(i, f"text {i}", "text", i) for i in range(50)], "id BIGINT, text STRING, type STRING, page BIGINT")
    queries = spark.createDataFrame([(1, "text 49 words", [1.0, 0.0])], "query_id BIGINT, query STRING, embedding ARRAY<DOUBLE>")
    seen = spark.sparkContext.accumulator(0)

    @F.pandas_udf("double")
    def scorer(q, p):
        seen.add(len(q))
        return p.str.len().astype(float)

    out = R.retrieve_rerank_context(queries, vectors, docs, top_n=3, scorer=lambda q, p: scorer(q, p)).collect()
    assert seen.value == 6 and out[0].n_hits == 3
    assert out[0].context.startswith("[Source ID: 1 | Type: TEXT | Page: 44]\ntext 44\n\n")


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab \n", max_size=400), st.integers(5, 40), st.integers(0, 4))
def test_recursive_chunks_fit_and_lose_nothing(text, size, overlap):
    text = "".join(c if c in " \n" else chr(0x4E00 + i) for i, c in enumerate(text))  # every letter occurs once
    chunks = split_recursive(text, size, overlap, ["\n\n", "\n", " ", ""])
    assert all(0 < len(c) <= size for c in chunks)
    at = 0
    for chunk in chunks:  # chunks follow one another in the text, with nothing but blanks between
        found = text.find(chunk)
        assert found >= 0 and not text[at:found].strip()
        assert at - found <= overlap
        at = found + len(chunk)
    assert not text[at:].strip()


def test_fixed_windows_cover_the_text(spark):
    df = spark.createDataFrame([(1, "x" * 801), (2, ""), (3, "abc"), (4, None)], "id BIGINT, text STRING")
    rows = R.chunk_fixed(df, text="text", key="id").collect()
    assert sorted((r.id, r.chunk_no, len(r.chunk)) for r in rows) == [(1, 0, 800), (1, 1, 121), (3, 0, 3)]


def test_group_without_live_tokens_is_kept(spark):
    df = spark.createDataFrame([("a", [3.0, 4.0], 1), ("a", [9.0, 9.0], 0), ("b", [1.0, 1.0], 0), ("c", [0.0, 0.0], 1)], "k STRING, v ARRAY<DOUBLE>, m INT")
    out = {r.k: r.embedding for r in R.masked_mean_pool(df, vectors="v", mask="m", by="k").collect()}
    assert out["a"] == pytest.approx([0.6, 0.8]) and out["b"] is None and out["c"] == [0.0, 0.0]


def test_scores_of_a_block_pair_are_made_in_small_parts(monkeypatch):
    sizes, scores = [], S._scores
    monkeypatch.setattr(S, "_scores", lambda *a: sizes.append(scores(*a).nbytes) or scores(*a))
    rng = np.random.default_rng(1)
    ids, vectors = np.arange(4000), rng.normal(size=(4000, 3))
    best = S._Running(ids, vectors, 2, "cosine")
    best.add(ids, vectors)
    assert max(sizes) <= 8 << 20 and sum(sizes) == 8 * 4000 * 4000
    assert [int(i[0]) for i in best.ids[:50]] == list(range(50))
