import random

import pytest
from pyspark.sql import functions as F

from tableworks.operators import ordering as O


@pytest.fixture(scope="module")
def messages(spark):
    """One thread holds a third of all rows and far more than one bucket."""
    rng = random.Random(7)
    rows = []
    for thread, n in [("hot", 400), *[(f"t{i}", rng.randint(1, 30)) for i in range(50)]]:
        turns = sorted(rng.sample(range(-50, 2000), n))
        rows += [(thread, t, rng.choice([None, None, None, "a", "b", "c"])) for t in turns]
    rng.shuffle(rows)
    return rows


def test_position_in_group(spark, messages):
    df = spark.createDataFrame(messages, "k STRING, o BIGINT, v STRING")
    got = {(r.k, r.o): r.p for r in O.position_in_group(df, by=["k"], order="o", out="p", width=16).collect()}
    for key in {m[0] for m in messages}:
        orders = sorted(m[1] for m in messages if m[0] == key)
        assert [got[key, o] for o in orders] == list(range(len(orders)))


@pytest.mark.parametrize("inclusive", [False, True])
def test_last_value_before(spark, messages, inclusive):
    df = spark.createDataFrame(messages, "k STRING, o BIGINT, v STRING")
    out = O.last_value_before(df, by=["k"], order="o", value="v", out="w", inclusive=inclusive, width=16)
    got = {(r.k, r.o): r.w for r in out.collect()}
    assert len(got) == len(messages)
    for key in {m[0] for m in messages}:
        last = None
        for _, o, v in sorted((m for m in messages if m[0] == key), key=lambda m: m[1]):
            if inclusive and v is not None:
                last = v
            assert got[key, o] == last
            if v is not None:
                last = v


def test_segments_join_to_the_whole(spark, messages):
    df = spark.createDataFrame([(k, i, v) for i, (k, _, v) in enumerate(messages)], "k STRING, o BIGINT, v STRING")
    placed = O.position_in_group(df, by=["k"], order="o", out="p", width=16)
    out = O.join_segments(placed, by=["k"], position="p", parts={"text": "v"}, width=16)
    got = {}
    for r in out.orderBy("k", "segment").collect():
        got[r.k] = got.get(r.k, "") + r.text
    assert out.where("k = 'hot'").count() == 25
    for key in got:
        assert got[key] == "".join(v for k, _, v in messages if k == key and v)


def test_null_key_stops_the_job(spark):
    df = spark.createDataFrame([(None, 1)], "k STRING, o BIGINT")
    with pytest.raises(Exception, match="null in key column k"):
        O.position_in_group(df, by=["k"], order="o", out="p").collect()


def test_global_position_over_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(O, "ROWS_PER_RANGE", 50)
    keys = random.Random(1).sample(range(10**6), 1000)
    out = O.global_position(spark.createDataFrame([(k,) for k in keys], "k BIGINT"), key="k", out="p").collect()
    assert [r.k for r in sorted(out, key=lambda r: r.p)] == sorted(keys)
    assert sorted(r.p for r in out) == list(range(1000))


def test_rank_by_hash_over_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(O, "ROWS_PER_RANGE", 1)
    df = spark.range(600).select("id", F.when(F.col("id") < 400, "big").otherwise("small").alias("c"), F.md5(F.col("id").cast("string")).alias("h"))
    rows = O.rank_by_hash(df, hash_col="h", by=["c"], out="r", total="n", rows=600).collect()
    for c, n in (("big", 400), ("small", 200)):
        mine = sorted((r for r in rows if r.c == c), key=lambda r: r.h)
        assert [r.r for r in mine] == list(range(1, n + 1)) and {r.n for r in mine} == {n}
