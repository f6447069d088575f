"""Streaming queries, each run over all files that wait and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import scratch_path, table
from ..streaming import operators as T
from ..streaming import tables as ST
from .registry import ORACLES, query
from .tabular import LOG_SQL, experiment_lines


@query("stream_guard", ORACLES["guard_flow"])
def stream_guard(spark, sf):
    """Labels arrive as a stream, documents are a table."""
    labels = ST.stream_table(spark, sf, "labels", table(spark, sf, "labels").schema)
    rows = labels.join(table(spark, sf, "documents"), "doc_id")
    toxic, good, n = F.col("toxic") == 1, F.col("quality") == 1, F.col("n_chars")
    raw = (
        F.when(toxic & good, '{"User Safety": "Unsafe", "Safety Categories": "Violence"}')
        .when(toxic, '{"User Safety": "safe", "Response Safety": "unsafe"}')
        .when(~good, "unsafe, because")
        .when(n < 600, '{"User Safety": "SAFE"}')
        .when(n < 1200, "{}")
        .otherwise('{"User Safety": "safe", "Response Safety": "safe"}')
    )
    messages = rows.select(
        F.col("doc_id").alias("case_id"), raw.alias("raw"), F.col("text").alias("response"), F.when(F.col("lang") == "de", "timeout").alias("error")
    )
    out = T.stream_guard(messages, input_raw="raw", output_raw="raw")
    return ST.write_available(out.select("case_id", "final_response", "blocked_at", "is_safe"), "guard")


@query("stream_threads", """
SELECT user_id, epoch(time_bucket(INTERVAL '1 day', ts))::BIGINT AS period_start, count(*) AS n_messages,
       epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) AS last_us,
       coalesce(arg_max(event_type || ' ' || event_id, ts) FILTER (event_type = 'purchase'), arg_max(event_type || ' ' || event_id, ts)) AS response,
       md5(string_agg(CASE WHEN event_type = 'purchase' THEN 'assistant' ELSE 'user' END || ': ' || event_type || ' ' || event_id, chr(10)
                      ORDER BY ts, event_type = 'purchase' DESC, event_type || ' ' || event_id)) AS history_md5
FROM events GROUP BY ALL""")
def stream_threads(spark, sf):
    """A user's day is a thread, events are its messages, purchases the replies; the threads still open at the end come from the state store."""
    events = ST.stream_table(spark, sf, "events", table(spark, sf, "events").schema)
    time = ST.as_instant("ts")
    messages = events.select(
        F.concat_ws(" ", "user_id", (F.floor(F.unix_seconds(time) / 86400) * 86400).cast("long")).alias("thread"), time.alias("time"),
        F.when(F.col("event_type") == "purchase", "assistant").otherwise("user").alias("role"), F.concat_ws(" ", "event_type", "event_id").alias("text"),
    )
    closed, state = ST.run_available(T.stream_threads(messages, thread="thread", time="time", role="role", text="text"), "threads")
    every = closed.unionByName(T.open_threads(spark, state, thread="thread"))
    told = F.array_join(F.transform("history", lambda m: F.concat(m["role"], F.lit(": "), m["text"])), "\n")
    return every.select(
        F.split("thread", " ")[0].cast("long").alias("user_id"), F.split("thread", " ")[1].cast("long").alias("period_start"), "n_messages",
        F.unix_micros("first_time").alias("first_us"), F.unix_micros("last_time").alias("last_us"), "response", F.md5(told).alias("history_md5"),
    )


@query("stream_chunks", """
SELECT conv_id AS stream_id, 0::BIGINT AS segment, count(*) AS n_deltas, coalesce(string_agg(text, '' ORDER BY turn) FILTER (role <> 'assistant'), '') AS reasoning,
       coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '') AS content
FROM conversations GROUP BY conv_id""")
def stream_chunks(spark, sf):
    """Threads are streams that start a minute apart, each message is one delta. They carry no end mark: a stream closes by silence, and
    those still open at the end come from the state store."""
    messages = ST.stream_table(spark, sf, "conversations", table(spark, sf, "conversations").schema)
    deltas = messages.select(
        F.col("conv_id").alias("stream_id"), F.col("turn").alias("seq"), F.timestamp_seconds(86400 + F.col("conv_id") * 60 + F.col("turn")).alias("time"),
        F.when(F.col("role") != "assistant", F.col("text")).alias("reasoning"), F.when(F.col("role") == "assistant", F.col("text")).alias("content"),
    )
    closed, state = ST.run_available(T.stream_chunks(deltas), "chunks")
    return closed.unionByName(T.open_chunks(spark, state))


@query("stream_experiment_log", LOG_SQL + """
SELECT 'test_accuracy' AS metric, arg_max(model, (test_accuracy, -timestamp)) AS model, max(test_accuracy) AS score,
       arg_max(timestamp, (test_accuracy, -timestamp)) AS timestamp, count(*) AS n_records FROM log
UNION ALL SELECT 'rmse', arg_min(model, (rmse, timestamp)), min(rmse), arg_min(timestamp, (rmse, timestamp)), count(*) FROM log""")
def stream_experiment_log(spark, sf):
    path = scratch_path(spark, "followed-log")
    experiment_lines(spark, sf).write.text(path)
    best = T.stream_experiment_log(ST.stream_lines(spark, path))
    target, state = scratch_path(spark, "log-best"), scratch_path(spark, "log-state")

    def replace(rows, _):  # complete mode: every batch brings one row per metric, which replaces the table
        rows.write.mode("overwrite").parquet(target)

    started = best.writeStream.foreachBatch(replace).outputMode("complete").option("checkpointLocation", state).trigger(availableNow=True).start()
    started.awaitTermination()
    return spark.read.parquet(target)
