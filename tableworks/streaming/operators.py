"""Operators over unbounded message streams.

Threads and streams of deltas keep their rows in keyed state (``keyed``); the experiment log keeps one aggregate per metric.
"""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..fixed_values import LOWER_IS_BETTER
from ..functions.json import is_json
from ..operators import safety as S
from ..operators.ordering import BUCKET_WIDTH
from ..sources.tables import EXPERIMENT_SCHEMA
from .keyed import CHUNK_OUT, THREAD_BUCKETS, THREAD_OUT, ChunkState, ThreadState, chunks_of, open_messages, open_rows, threads_of

WATERMARK = "10 minutes"


def stream_guard(sdf: DataFrame, *, input_raw: str, output_raw: str, response: str = "response", error: str = "error") -> DataFrame:
    """Verdict texts to outcomes, row by row; the same columns as the batch form."""
    parsed = S.parse_safety(S.parse_safety(sdf, col=input_raw, out="input_verdict"), col=output_raw, out="output_verdict")
    return S.guard_flow(parsed, response=response, error=error)


def _micros(time: str) -> Column:
    return F.unix_micros(F.col(time)).alias("time")


def _instants(rows: DataFrame) -> DataFrame:
    """Times kept in microseconds as time stamps."""
    told = F.transform("history", lambda m: F.struct(F.timestamp_micros(m["time"]).alias("time"), m["role"].alias("role"), m["text"].alias("text")))
    return rows.withColumns({"first_time": F.timestamp_micros("first_time"), "last_time": F.timestamp_micros("last_time"), "history": told})


def stream_threads(
    sdf: DataFrame, *, thread: str, time: str, role: str, text: str, ttl: timedelta = timedelta(days=1), watermark: str = WATERMARK,
    ai: str = "assistant", width: int = BUCKET_WIDTH, buckets: int = THREAD_BUCKETS,
) -> DataFrame:
    """Threads with their history, put out and forgotten when ``ttl`` has passed since their last use.

    Gives (thread, segment, n_messages, first_time, last_time, response, history). ``response`` is the last non-empty model text, else
    the last text. ``history`` has the messages in order (time, role, text); a thread of more than ``width`` messages has several
    segments, cut in the order of arrival, and the sums of the whole thread in each. A thread that is used again after it expired starts anew.
    Messages later than the watermark are dropped and counted in the progress metrics; rows without a thread or a time are left out.
    State is kept by ``buckets`` of threads: a batch reads the sums of all open threads in the buckets that it touches.

    Needs the RocksDB state store, which ``streaming.tables`` sets for its queries. ``open_threads`` gives the threads that are still open
    when a query ends.
    """
    rows = sdf.where(F.col(thread).isNotNull() & F.col(time).isNotNull()).withWatermark(time, watermark)
    bucket = F.pmod(F.xxhash64(thread), F.lit(buckets)).cast("int").alias("bucket")
    rows = rows.select(bucket, F.col(thread).alias("thread"), F.col(time).alias("event_time"), _micros(time), F.col(role).alias("role"), F.col(text).alias("text"))
    kind = sdf.schema[thread].dataType.simpleString()
    state = ThreadState(kind, ai, int(ttl.total_seconds() * 1000), width)
    out = rows.groupBy("bucket").transformWithState(state, f"thread {kind}, {THREAD_OUT}", "append", "eventTime")
    return _instants(out).withColumnRenamed("thread", thread)


def open_threads(spark: SparkSession, checkpoint: str, *, thread: str, ai: str = "assistant") -> DataFrame:
    """The threads that a stopped ``stream_threads`` query still holds, in the same columns."""
    return _instants(threads_of(open_messages(spark, checkpoint), ai)).withColumnRenamed("thread", thread)


def stream_chunks(
    sdf: DataFrame, *, stream: str = "stream_id", order: str = "seq", time: str = "time", last: str | None = None,
    timeout: timedelta = timedelta(minutes=30), watermark: str = WATERMARK, width: int = BUCKET_WIDTH,
) -> DataFrame:
    """Deltas to whole texts (stream, segment, n_deltas, reasoning, content), put out once.

    ``order`` counts a stream's deltas from 0, ``last`` names a column that marks the last one. A stream comes in segments of ``width``
    deltas, each with its own state, so that a hot stream is spread and no state grows without bound. A segment is complete when it is
    full or when all deltas up to the marked one are there, in whatever order; a pause does not tear it. Without a mark, or
    if a delta is lost, it comes out after ``timeout`` without a new delta. ``open_chunks`` gives what is open when a query ends.
    Rows without a stream, order or time are left out; a watermark starts at 1970, so times before that are late.
    """
    rows = sdf.where(F.col(stream).isNotNull() & F.col(order).isNotNull() & F.col(time).isNotNull()).withWatermark(time, watermark)
    rows = rows.select(
        F.col(stream).alias("stream"), F.expr(f"`{order}` div {width}").cast("long").alias("segment"), F.col(order).cast("long").alias("seq"), F.col(time).alias("event_time"),
        _micros(time), "reasoning", "content", (F.coalesce(F.col(last), F.lit(False)) if last else F.lit(False)).alias("last"),
    )
    schema = f"stream {sdf.schema[stream].dataType.simpleString()}, {CHUNK_OUT}"
    state = ChunkState(int(timeout.total_seconds() * 1000), width)
    return rows.groupBy("stream", "segment").transformWithState(state, schema, "append", "eventTime").withColumnRenamed("stream", stream)


def open_chunks(spark: SparkSession, checkpoint: str, *, stream: str = "stream_id") -> DataFrame:
    """The segments that a stopped ``stream_chunks`` query still holds, in the same columns."""
    return chunks_of(open_rows(spark, checkpoint, "deltas", ["stream", "segment"])).withColumnRenamed("stream", stream)


def stream_experiment_log(lines: DataFrame, *, schema: str = EXPERIMENT_SCHEMA, value: str = "value") -> DataFrame:
    """Running best per metric of a followed log; broken and blank lines are skipped.

    Use update or complete mode: one row per metric name is the whole state.
    """
    text = F.trim(value)
    records = lines.where((F.length(text) > 0) & is_json(text)).select(F.from_json(text, schema).alias("r")).select("r.*")
    scores = records.select("model", "timestamp", F.explode("metrics").alias("metric", "score")).where(F.col("score").isNotNull())
    words = F.split(F.lower("metric"), "_")
    lower = F.arrays_overlap(words, F.array(*[F.lit(m) for m in LOWER_IS_BETTER]))
    goodness = F.when(lower, -F.col("score")).otherwise(F.col("score"))
    best = F.max_by(F.struct("model", "score", "timestamp"), F.struct(goodness, -F.coalesce("timestamp", F.lit(0.0))))
    return scores.groupBy("metric").agg(best.alias("b"), F.count("*").alias("n_records")).select("metric", "b.*", "n_records")
