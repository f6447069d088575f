import datetime as dt
import os
import random
import time

from tableworks.plans import QUERIES
from tableworks.streaming import operators as T
from tableworks.streaming import tables as ST

DAY = dt.datetime(2024, 1, 1)


def at(hours: float) -> dt.datetime:
    return DAY + dt.timedelta(hours=hours)


def in_files(spark, folder, schema, *batches):
    """One file per batch, read one at a time in this order."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/part{i}")
        names = [n for n in os.listdir(f"{folder}/part{i}") if n.endswith(".parquet")]
        os.utime(f"{folder}/part{i}/{names[0]}", (time.time() - 1000 + i,) * 2)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(folder)


MESSAGES = "thread STRING, time TIMESTAMP, role STRING, text STRING"
DAYS = dt.timedelta(days=1)


def threads(spark, folder, *batches, **options):
    names = dict(thread="thread", time="time", role="role", text="text")
    closed, state = ST.run_available(T.stream_threads(in_files(spark, folder, MESSAGES, *batches), **names, **options), "t")
    return closed, T.open_threads(spark, state, thread="thread")


def told(df):
    return {(r.thread, r.first_time, r.segment): (r.n_messages, r.last_time, r.response, [(m.time, m.role, m.text) for m in r.history]) for r in df.collect()}


def test_threads_expire_after_their_last_use_and_late_rows_are_dropped(spark, tmp_path):
    a = [("a", at(1), "user", "q1"), ("a", at(2), "assistant", "r1"), ("a", at(20), "user", "q2"), ("a", at(40), "assistant", "r2")]
    closed, left = threads(
        spark, str(tmp_path / "in"),
        a[:2][::-1],  # the second message comes first in its file
        [a[2], ("b", at(20), "user", "other")],
        [a[3], ("b", at(41), "user", None)],  # a: 20 hours of silence do not end it
        [("c", at(80), "user", "far")],  # moves the watermark past everybody's expiry
        [("a", at(3), "user", "too late"), ("a", at(90), "user", "anew")],
    )
    assert told(closed) == {
        ("a", at(1), 0): (4, at(40), "r2", [m[1:] for m in a]), ("b", at(20), 0): (2, at(41), "other", [(at(20), "user", "other"), (at(41), "user", None)]),
    }
    assert told(left) == {("c", at(80), 0): (1, at(80), "far", [(at(80), "user", "far")]), ("a", at(90), 0): (1, at(90), "anew", [(at(90), "user", "anew")])}


def test_any_cut_into_batches_gives_the_threads_of_one_batch(spark, tmp_path):
    rng = random.Random(5)
    rows = [(f"t{rng.randint(0, 5)}", at(i / 6), rng.choice(["user", "assistant"]), rng.choice([None, "", f"m{i}"])) for i in range(90)]
    once = threads(spark, str(tmp_path / "one"), rows)
    thrice = threads(spark, str(tmp_path / "three"), rows[:40], rows[40:70], rows[70:])
    whole = [told(x.unionByName(y)) for x, y in (once, thrice)]
    assert whole[0] == whole[1] and sum(n for n, *_ in whole[0].values()) == 90
    plain = {}
    for t, time, role, text in rows:
        plain.setdefault(t, []).append((time, role, text))
    assert {t: [m for m in h] for (t, _, _), (*_, h) in whole[0].items()} == plain


def test_a_long_thread_comes_in_segments(spark, tmp_path):
    rows = [("hot", at(i / 60), "user", str(i)) for i in range(25)] + [(None, at(1), "user", "x"), ("y", None, "user", "x")]
    closed, left = threads(spark, str(tmp_path / "in"), rows[:7], rows[7:], [("z", at(100), "user", "end")], width=10)
    assert {k[2]: (v[0], len(v[3])) for k, v in told(closed).items()} == {0: (25, 10), 1: (25, 10), 2: (25, 5)}
    assert [k[0] for k in told(left)] == ["z"]


def test_threads_of_a_bucket_share_the_store_and_keep_their_segments(spark, tmp_path):
    rng = random.Random(7)
    rows = [(rng.choice(["hot"] * 8 + [f"t{i}" for i in range(30)]), at(i / 20), "user", f"m{i}") for i in range(400)]
    sdf = in_files(spark, str(tmp_path / "in"), MESSAGES, rows[:150], rows[150:160], rows[160:], [("end", at(45), "user", "x")], [("end", at(46), "user", "y")])
    names = dict(thread="thread", time="time", role="role", text="text")
    out, state = ST.run_available(T.stream_threads(sdf, **names, ttl=dt.timedelta(hours=6), watermark="1 hour", width=8, buckets=2), "t")
    kept = spark.read.format("statestore").option("path", state).option("stateVarName", "sums").load()
    assert 1 <= kept.select("key").distinct().count() <= 2
    found = told(out.unionByName(T.open_threads(spark, state, thread="thread")))
    plain, watermark = {}, -1.0
    for batch in (rows[:150], rows[150:160], rows[160:]):  # a thread starts anew when a batch comes after its expiry
        for t, time, _, text in batch:
            hours = (time - DAY).total_seconds() / 3600
            runs = plain.setdefault(t, [])
            if not runs or runs[-1][-1][0] + 6 <= watermark:
                runs.append([])
            runs[-1].append((hours, text))
        watermark = (batch[-1][1] - DAY).total_seconds() / 3600 - 1
    for t, runs in plain.items():
        for run in runs:
            for segment in range(0, len(run), 8):
                n, last, _, history = found.pop((t, at(run[0][0]), segment // 8))
                assert n == len(run) and abs(last - at(run[-1][0])) < dt.timedelta(seconds=1)
                assert [m[2] for m in history] == [x for _, x in run[segment : segment + 8]]
    assert [k[0] for k in found] == ["end"]


DELTAS = "stream_id STRING, seq BIGINT, time TIMESTAMP, reasoning STRING, content STRING, done BOOLEAN"


def delta(stream, seq, minute, done=None):
    return (stream, seq, at(minute / 60), "r" if seq < 3 else None, None if seq < 3 else str(seq), done)


def test_deltas_close_by_mark_by_size_by_silence_or_at_the_end(spark, tmp_path):
    marked = [delta("m", 2, 0), delta("m", 0, 0), delta("m", 3, 1, True)]
    paused = [delta("p", 0, 0), delta("p", 1, 7), delta("p", 2, 30)]
    long = [delta("l", i, i) for i in (2, 0, 1, 3, 5, 4)]
    sdf = in_files(
        spark, str(tmp_path / "in"), DELTAS, [*marked, paused[0], *long[:3]], [paused[1], *long[3:], (None, 1, at(0), "x", "x", None)],
        [delta("m", 1, 8), delta("m", 1, 8)], [paused[2], delta("m", 3, 20, True)], [delta("late", 0, 300)],
    )
    closed, state = ST.run_available(T.stream_chunks(sdf, width=4, last="done"), "c")
    rows = {(r.stream_id, r.segment, r.n_deltas, r.reasoning, r.content) for r in closed.collect()}
    assert closed.count() == len(rows)
    assert rows == {("m", 0, 4, "rrr", "3"), ("p", 0, 3, "rrr", ""), ("l", 0, 4, "rrr", "3"), ("l", 1, 2, "", "45")}
    assert [tuple(r) for r in T.open_chunks(spark, state).collect()] == [("late", 0, 1, "r", "")]


def test_the_session_keeps_its_state_store(spark):
    before = spark.conf.get(ST.PROVIDER, None)
    with ST.state_store(spark):
        assert "RocksDB" in spark.conf.get(ST.PROVIDER)
    assert spark.conf.get(ST.PROVIDER, None) == before


def test_guard_stream_equals_the_batch(spark, tmp_path):
    schema = "raw STRING, response STRING, error STRING"
    rows = [('{"User Safety": "safe"}', "fine", None), ("broken", "x", None), ('{"User Safety": "safe"}', None, "timeout"),
            ('{"User Safety": "safe", "Response Safety": "UNSAFE"}', "y", None)]
    sdf = in_files(spark, str(tmp_path / "in"), schema, rows[:2], rows[2:])
    cols = ["response", "final_response", "is_safe", "blocked_at"]
    streamed = ST.write_available(T.stream_guard(sdf, input_raw="raw", output_raw="raw").select(*cols), "g").collect()
    batch = T.stream_guard(spark.createDataFrame(rows, schema), input_raw="raw", output_raw="raw").select(*cols).collect()
    assert sorted(map(str, streamed)) == sorted(map(str, batch))
    assert [r.blocked_at for r in batch] == [None, "input_validation", "agent_execution", "output_validation"]


def test_log_best_handles_direction_and_ties(spark):
    lines = ['{"model": "a", "metrics": {"r2": 0.5, "test_rmse": 2}, "timestamp": 2}', "", "{broken",
             '{"model": "b", "metrics": {"r2": 0.5, "test_rmse": 1}, "timestamp": 1}']
    df = spark.createDataFrame([(x,) for x in lines], "value STRING")
    assert {r.metric: (r.model, r.score, r.n_records) for r in T.stream_experiment_log(df).collect()} == {"r2": ("b", 0.5, 2), "test_rmse": ("b", 1.0, 2)}


def test_a_table_of_many_files_is_streamed_as_one_of_a_single_file(spark, tmp_path):
    rows = spark.createDataFrame([(1, 0, "user", "ab"), (1, 1, "assistant", "c"), (2, 0, "user", "d")], "conv_id LONG, turn LONG, role STRING, text STRING")
    rows.repartition(3).write.parquet(f"{tmp_path}/many/conversations.parquet")
    os.makedirs(f"{tmp_path}/one")
    rows.toPandas().to_parquet(f"{tmp_path}/one/conversations.parquet")
    for folder in ("one", "many"):
        out = QUERIES["stream_chunks"](spark, f"{tmp_path}/{folder}")
        assert sorted(map(tuple, out.collect())) == [(1, 0, 2, "ab", "c"), (2, 0, 1, "d", "")]
